"""Column-expression helpers (scalar functions).

Every helper returns a ``Column`` built only from Spark built-ins, so it stays
inside whole-stage codegen. Each has a DuckDB twin in ``quarry.plans.sqlfrag``
so the oracle SQL computes the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Token pattern shared by BM25, language vote and answer scoring.
TOKEN_RE = r"[\p{L}\p{N}]+"
# Strict number literal; Spark would otherwise cast '12d' to 12.0.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Numbers inside free text (answer audit).
TEXT_NUMBER_RE = r"-?\d[\d,]*\.?\d*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the ASCII whitespace set stripped by ``strip`` (``\s``).
WHITESPACE = " \t\n\r\f\x0b"


def strip(c) -> Column:
    """``str.strip()`` for ASCII whitespace; plain SQL ``trim`` removes only
    spaces."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def num(c) -> Column:
    """Strict string -> double; NULL when the text is not a plain number."""
    s = strip(_c(c).cast("string"))
    return F.when(s.rlike(NUMBER_RE), s.cast("double"))


def tokens(c) -> Column:
    """Lower-cased letter/digit runs."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_RE), 0)


def is_blank(c) -> Column:
    """F12 cell_is_blank: NULL, NaN or whitespace only."""
    s = _c(c).cast("string")
    return s.isNull() | (F.lower(strip(s)) == "nan") | (strip(s) == "")


def fmt_num(x) -> Column:
    """whole -> '1,234'; otherwise two decimals with separators.
    Non-finite values keep their string form."""
    raw = _c(x)
    x = raw.try_cast("double")
    x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # -0.0 prints as 0, like int(-0.0)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (F.when(~finite, raw.cast("string"))
            .when(x == F.floor(x), F.format_number(x, 0))
            .otherwise(F.format_number(x, 2)))


def extract_numbers(c) -> Column:
    """every number literal in a text, commas and trailing dots removed."""
    toks = F.regexp_extract_all(_c(c), F.lit(TEXT_NUMBER_RE), 0)
    vals = F.transform(toks, lambda t: num(F.regexp_replace(
        F.regexp_replace(t, r"^\.+|\.+$", ""), ",", "")))
    return F.filter(vals, lambda v: v.isNotNull())


def verify_numbers(text, allowed) -> Column:
    """every allowed value is within 0.01 of some number in the text.
    An empty ``allowed`` list is vacuously true."""
    nums = extract_numbers(text)
    return F.forall(_c(allowed), lambda a: F.exists(nums, lambda n: F.abs(a - n) < 0.01))


def finite_numbers(arr) -> Column:
    """the finite numeric values of an array of cells/values."""
    vals = F.transform(_c(arr), lambda v: num(v))
    return F.filter(vals, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def parse_amount(c) -> Column:
    """drop thousands separators, strip, parse."""
    return num(F.regexp_replace(_c(c).cast("string"), ",", ""))


def largest_number(arr) -> Column:
    """greatest parseable amount in a row of cells, NULL if none."""
    vals = F.filter(F.transform(_c(arr), lambda v: parse_amount(v)), lambda v: v.isNotNull())
    return F.array_max(vals)


_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
          r"nov(?:ember)?|dec(?:ember)?)\.?")
_DAY, _YEAR, _GAP = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})", r"[-/., ]+"
_TIME = r"(?i)^(.*\d),?[T ]\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[AP]M)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?$"
#: Layouts of a date: pattern, and its groups as year, month, day.
DATE_LAYOUTS = [(r"(?i)^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", "$1", "$2", "$3"),
                (r"^(\d{4})(\d{2})(\d{2})$", "$1", "$2", "$3"),
                (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", "$3", "$1", "$2"),
                (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", "$3", "$2", "$1"),
                (f"(?i)^{_DAY}{_GAP}{_MONTH}{_GAP}{_YEAR}$", "$3", "$2", "$1"),
                (f"(?i)^{_MONTH}{_GAP}{_DAY}{_GAP}{_YEAR}$", "$3", "$1", "$2"),
                (f"(?i)^(\\d{{4}}){_GAP}{_MONTH}{_GAP}{_DAY}$", "$1", "$2", "$3")]


def coerce_date(c, min_year: int | None = None) -> Column:
    """F8: text -> DATE, NULL when unparseable (or before ``min_year``). A time
    after the date is dropped, in any layout. Numeric dates are month first, else
    day first; a year of two digits is 1969 to 2068; months may be named in full."""
    s = F.regexp_replace(strip(_c(c).cast("string")), _TIME, "$1")

    def part(pattern: str, group: str) -> Column:
        return F.regexp_replace(s, pattern, group)

    def year(y: Column) -> Column:
        return F.when(F.length(y) == 2, F.concat(F.when(y >= "69", F.lit("19")).otherwise(F.lit("20")), y)).otherwise(y)

    def month(m: Column) -> Column:
        at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(m, 1, 3)))
        return F.when(m.rlike("^[0-9]"), m).otherwise(F.floor((at + 2) / 3).cast("string"))

    d = F.coalesce(*[F.when(s.rlike(p), F.to_date(F.try_to_timestamp(
        F.concat_ws("-", year(part(p, y)), month(part(p, m)), part(p, day)), F.lit("yyyy-M-d")))) for p, y, m, day in DATE_LAYOUTS])
    if min_year is not None:
        d = F.when(F.year(d) >= min_year, d)
    return d


def extract_json_text(c) -> Column:
    """F9 (first half): greedy outermost ``{...}`` across lines."""
    return F.regexp_extract(_c(c), r"(?s)\{.*\}", 0)


def basename(c) -> Column:
    """last path component."""
    return F.element_at(F.split(_c(c), "/"), -1)


def extension(c) -> Column:
    """lower-cased suffix including the dot ('' if none)."""
    return F.regexp_extract(F.lower(basename(c)), r"[^.](\.[^./]+)$", 1)


def stem(c) -> Column:
    """basename without its suffix."""
    b = basename(c)
    return F.regexp_replace(b, r"([^.])\.[^./]+$", "$1")


def linearize(arr, sep: str) -> Column:
    """P5: row cells -> one text line; NULL cells become empty strings.
    (``concat_ws`` would drop NULLs and shift columns.)"""
    return F.array_join(F.transform(_c(arr), lambda v: F.coalesce(v.cast("string"), F.lit(""))), sep)


def round6(c) -> Column:
    return F.round(_c(c), 6)
