"""Registered chat-memory queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import conversation as CV
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.registry import query

_WIN = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query("rolling_history", f"""
SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(h, lambda s: s.ok), lambda s: s.l),
         chr(10)), '') AS history,
       len(list_filter(h, lambda s: s.ok)) AS n_history
FROM (SELECT conv_id, turn, coalesce(list({{'l': CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': '
         || {S.strip('text')}, 'ok': coalesce({S.strip('text')}, '') <> ''}}) {_WIN}, []) AS h
      FROM conversations)""")
def rolling_history(spark, d):
    c = FX.table(spark, d, "conversations")
    return CV.rolling_history(c).select("conv_id", "turn", "history", "n_history")


@query("contextualize_batch", f"""
SELECT conv_id, turn, CASE WHEN p IS NOT NULL THEN p || ' ' || text ELSE text END AS standalone FROM (
  SELECT conv_id, turn, text, last(CASE WHEN role = 'user' AND {S.strip('text')} <> '' THEN {S.strip('text')} END
         IGNORE NULLS) {_WIN} AS p
  FROM conversations) """)
def contextualize_batch(spark, d):
    c = FX.table(spark, d, "conversations")
    return CV.contextualize(c).select("conv_id", "turn", "standalone")


@query("parse_history", f"""
SELECT conv_id, turn, len(kept) AS n_items,
  coalesce(array_to_string(list_transform(kept, lambda x: coalesce(x.role, '') || ': ' || x.content), chr(10)), '') AS items
FROM (
  SELECT conv_id, turn, CASE WHEN len(k) > 12 THEN k[-12:] ELSE k END AS kept FROM (
    SELECT conv_id, turn, list_filter(coalesce(from_json(raw, '[{{"role":"VARCHAR","content":"VARCHAR"}}]'), []),
           lambda x: x IS NOT NULL AND coalesce({S.strip('x.content')}, '') <> '') AS k FROM (
      SELECT conv_id, turn, CAST(to_json(coalesce(list({{'role': role, 'content': text}})
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), [])) AS VARCHAR) AS raw
      FROM conversations)))""")
def parse_history(spark, d):
    """P16 on the JSON history a request carries (the previous 12 turns)."""
    c = CV.raw_history(FX.table(spark, d, "conversations"))
    kept = CV.parse_history(F.col("raw"))
    return c.select("conv_id", "turn", F.size(kept).alias("n_items"),
                    F.array_join(F.transform(kept, lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "),
                                                                      x["content"])), "\n").alias("items"))
