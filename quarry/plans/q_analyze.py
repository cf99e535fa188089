"""Registered metadata-extraction query (R7) and schema validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analyze as AN
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.registry import query


def _cnt(words):
    return "len(list_filter(toks, lambda t: t IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


_LANGS = list(AN.STOP_WORDS)
_VOTE = ("CASE " + " ".join(
    f"WHEN {_LANGS[i]}_n = greatest({', '.join(l + '_n' for l in _LANGS)}) AND "
    f"greatest({', '.join(l + '_n' for l in _LANGS)}) > 0 THEN '{_LANGS[i]}'" for i in range(len(_LANGS)))
    + " END")


@query("extract_metadata", f"""
SELECT doc_id, title, date_created, last_modified_date, publisher, {_VOTE} AS language,
  marks AS n_page_marks,
  CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment_tone
FROM (
  SELECT doc_id,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')}), lambda l: l <> '')[1] AS title,
    regexp_extract_all(text, '\\b((19|20)\\d{{2}}-\\d{{2}}-\\d{{2}})\\b', 1)[1] AS date_created,
    regexp_extract_all(text, '\\b((19|20)\\d{{2}}-\\d{{2}}-\\d{{2}})\\b', 1)[-1] AS last_modified_date,
    nullif(regexp_extract(text, '(?m)^\\s*Publisher\\s*:\\s*(.+?)\\s*$', 1), '') AS publisher,
    len(regexp_extract_all(text, '--- Page \\d+ ---')) AS marks,
    {', '.join(_cnt(w) + ' AS ' + l + '_n' for l, w in AN.STOP_WORDS.items())},
    {_cnt(AN.POSITIVE)} AS pos, {_cnt(AN.NEGATIVE)} AS neg
  FROM (SELECT doc_id, text, {S.tokens('text')} AS toks FROM documents))""")
def extract_metadata(spark, d):
    """R7 over every document; the SQL-checkable scalar fields."""
    m = AN.extract_metadata(FX.table(spark, d, "documents").select("doc_id", "text"))
    return m.select("doc_id", "title", "date_created", "last_modified_date", "publisher", "language",
                    F.coalesce("page_count", F.lit(0)).alias("n_page_marks"), "sentiment_tone")


@query("validate_schema")
def validate_schema(spark, d):
    """every document's full analysis record serialised to JSON and
    parsed back against the fixed record schema; rows that do not fit go to
    a quarantine flag instead of failing the job."""
    from quarry.operators.infer import validate_json
    m = AN.extract_metadata(FX.table(spark, d, "documents").select("doc_id", "text"))
    rec = m.select("doc_id", F.to_json(F.struct(
        F.coalesce("summary", F.array().cast("array<string>")).alias("Summary"), F.coalesce("title", F.lit("Not Available")).alias("Title"), F.coalesce("author", F.array().cast("array<string>")).alias("Author"),
        F.coalesce("date_created", F.lit("Not Available")).alias("DateCreated"), F.coalesce("last_modified_date", F.lit("Not Available")).alias("LastModifiedDate"),
        F.coalesce("publisher", F.lit("Not Available")).alias("Publisher"), F.coalesce("language", F.lit("Not Available")).alias("Language"),
        F.coalesce("page_count", F.lit(0)).alias("PageCount"), F.coalesce("sentiment_tone", F.lit("Not Available")).alias("SentimentTone"))).alias("raw"))
    return validate_json(rec, "raw", METADATA_SCHEMA)


METADATA_SCHEMA = ("Summary array<string>, Title string, Author array<string>, DateCreated string, "
                   "LastModifiedDate string, Publisher string, Language string, PageCount int, "
                   "SentimentTone string")

# Stand-in answers of a model that lists changes: whole ones, and the usual faults
# (a missing field, a text for a list, an unended or empty answer, prose, none).
CHANGES_SCHEMA = "Page string, Added array<string>, Removed array<string>"
_FAULTS = ['[{"Page":"%p","Added":["a %i","b"],"Removed":[]},{"Page":"x","Added":[],"Removed":["c"]}]',
           '[{"Page":"%p","Added":["a"]},{"Page":"%p","Added":["a"],"Removed":["b","c"]}]',
           '[{"Page":"%p","Added":"a","Removed":[]}]', '[{"Page":"%p","Added":["a"],"Remo', "[]", "I found no changes on %p.", None,
           '{"Page":"%p","Added":[],"Removed":[]}', '  [{"Page":"%p","Added":[],"Removed":[],"More":1},null]']


@query("validate_changes", "WITH f(k, t) AS (VALUES " + ", ".join(
    f"({k}, {'NULL' if t is None else chr(39) + t + chr(39)})" for k, t in enumerate(_FAULTS)) + f"""),
r AS (SELECT doc_id, replace(replace(t, '%p', lang || '-' || doc_id), '%i', source) AS raw FROM documents JOIN f ON doc_id % {len(_FAULTS)} = k),
l AS (SELECT doc_id, CASE WHEN coalesce(json_valid(raw), false) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'ARRAY'
  THEN json_extract(CASE WHEN json_valid(raw) THEN raw END, '$[*]') END AS es FROM r),
e AS (SELECT doc_id, unnest(range(len(es))) AS at_, unnest(es) AS e FROM l WHERE len(es) > 0
  UNION ALL SELECT doc_id, NULL, NULL FROM l WHERE coalesce(len(es), 0) = 0),
c AS (SELECT *, json_type(e, '$.Page') = 'VARCHAR' AND json_type(e, '$.Added') = 'ARRAY' AND json_type(e, '$.Removed') = 'ARRAY' AS ok FROM e)
SELECT doc_id, CAST(coalesce(at_, -1) AS INTEGER) AS place, coalesce(ok, false) AS valid, CASE WHEN ok THEN json_extract_string(e, '$.Page') END AS page,
  CASE WHEN ok THEN CAST(json_array_length(e, '$.Added') AS INTEGER) ELSE -1 END AS n_added,
  CASE WHEN ok THEN json_extract_string(e, '$.Added[0]') END AS first_added,
  CASE WHEN ok THEN CAST(json_array_length(e, '$.Removed') AS INTEGER) ELSE -1 END AS n_removed FROM c""")
def validate_changes(spark, d):
    """answers that should list changes by page, checked record by record;
    -1 stands for no place and for the sizes of a record that is not valid."""
    from quarry.operators.infer import validate_json_list
    t = F.get(F.array(*[F.lit(x) for x in _FAULTS]), (F.col("doc_id") % len(_FAULTS)).cast("int"))
    raw = F.replace(F.replace(t, F.lit("%p"), F.concat_ws("-", "lang", "doc_id")), F.lit("%i"), F.col("source"))
    rows = validate_json_list(FX.table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw", CHANGES_SCHEMA)
    ok = F.when(F.col("valid"), F.col("record"))
    return rows.select("doc_id", F.coalesce("at", F.lit(-1)).alias("place"), "valid", ok["Page"].alias("page"), F.when(F.col("valid"), F.size(ok["Added"])).otherwise(-1).alias("n_added"),
                       F.get(ok["Added"], 0).alias("first_added"), F.when(F.col("valid"), F.size(ok["Removed"])).otherwise(-1).alias("n_removed"))
