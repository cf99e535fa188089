"""DuckDB twins of ``quarry.functions.exprs`` (oracle SQL only)."""

from __future__ import annotations

# Layouts that the fixture's cells use; exprs.coerce_date takes more (tests/test_limits.py).
DATE_RE = r"^[0-9A-Za-z]{1,4}[-/ ][0-9A-Za-z]{1,3}[-/ ]\d{1,4}( \d{1,2}:\d{2}:\d{2})?$"


def strip(x: str) -> str:
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def num(x: str) -> str:
    s = strip(x)
    return (f"CASE WHEN regexp_matches({s}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
            f"THEN CAST({s} AS DOUBLE) END")


def amount(x: str) -> str:
    return num(f"replace({x}, ',', '')")


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) = 'nan' OR {strip(x)} = '')"


def fmt_num(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN CAST({x} AS VARCHAR) "
            f"WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) "
            f"ELSE format('{{:,.2f}}', {x}) END")


def coerce_date(x: str) -> str:
    s = strip(x)
    g = f"CASE WHEN regexp_matches({s}, '{DATE_RE}') THEN {s} END"
    fmts = ["%Y-%m-%d", "%Y/%m/%d", "%m-%d-%Y", "%m/%d/%Y", "%d-%m-%Y", "%d/%m/%Y", "%d-%b-%Y", "%d %b %Y", "%b %d %Y",
            "%Y-%m-%d %H:%M:%S"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({g}, '{f}')" for f in fmts) + ") AS DATE)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def extract_numbers(x: str) -> str:
    inner = amount("regexp_replace(t, '^\\.+|\\.+$', '', 'g')")
    return (f"list_filter(list_transform(regexp_extract_all({x}, '-?\\d[\\d,]*\\.?\\d*'), "
            f"lambda t: {inner}), lambda v: v IS NOT NULL)")


def verify_numbers(text: str, allowed: str) -> str:
    return (f"(len({allowed}) = 0 OR list_bool_and(list_transform({allowed}, lambda a: "
            f"len(list_filter({extract_numbers(text)}, lambda n: abs(a - n) < 0.01)) > 0)))")
