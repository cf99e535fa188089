"""Registered queries of the training-data operators, with DuckDB oracles where
SQL can express them (the others are held against brute force in tests/llm)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (bloom_lm, chat_format, collocations, exact_dedup, filter_audit, fm_dedup, line_quality, mixing, qda, simhash, token_orc, viterbi_pieces,
                        warc)
from quarry.llm.common import table
from quarry.session import scratch_path

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
SQL_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


@query("op1_line_quality", rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
gr AS (SELECT doc_id, p, list_slice(w, p, p + 4) AS gram FROM g),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM gr) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, p - coalesce(prev, -5))) AS n FROM
  (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, host, t, trim(regexp_replace(regexp_replace(lower(line), '\p{{N}}', '0', 'g'), '[^\p{{L}}0]+', ' ', 'g')) AS line FROM raw),
lines AS (SELECT doc_id, host, t, line, sum(length(line)) AS chars FROM norm WHERE line <> '' GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM lines GROUP BY host),
bad AS (SELECT l.host, l.line FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  GROUP BY l.host, l.line, h.n HAVING count(DISTINCT t) > {line_quality.MIN_DOCS} AND count(DISTINCT t) > h.n * {line_quality.MAX_SHARE}),
marked AS (SELECT l.doc_id, l.chars, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b
  ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line),
removed AS (SELECT doc_id, sum(gone::BIGINT)::BIGINT AS k, sum(CASE WHEN gone THEN chars ELSE 0 END)::DOUBLE / sum(chars) AS share FROM marked GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
out AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT o.*, coalesce(k, 0) AS n_removed_lines, coalesce(share, 0.0) AS removed_share,
  NOT base_failed AND 1.0 - coalesce(share, 0.0) >= {line_quality.MIN_LEFT} AS kept
FROM out o LEFT JOIN removed USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


@query("op2_mix_sources", f"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k,
  sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
  sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
  sum(source_size) OVER () AS total FROM s),
lv AS (SELECT (total - coalesce(capped, 0))::DOUBLE / open_w::DOUBLE AS level FROM r
  WHERE w * ((total - coalesce(capped, 0))::DOUBLE / open_w::DOUBLE) <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * level) AS target FROM s, lv),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT *, target - copies * source_size AS budget FROM b),
hs AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
run AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs),
edge AS (SELECT source, min_by(h, h) AS h, min_by(upto - n, h) AS below, min_by(n, h) AS n FROM run JOIN c ON run.source IS NOT DISTINCT FROM c.source
  WHERE upto > budget GROUP BY run.source),
cut AS (SELECT c.*, e.h + CASE WHEN e.below + e.n - c.budget < c.budget - e.below THEN 1 ELSE 0 END AS cut
  FROM c LEFT JOIN edge e ON c.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * least(3, copies + CASE WHEN d.h < coalesce(cut, 1152921504606846975) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source""".replace("SELECT source, min_by(h, h)", "SELECT run.source, min_by(h, h)"))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_bloom_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    return bloom_lm.score_texts(table(spark, sf_dir, "documents"), learned).select(
        "doc_id", (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_warc_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(warc.archive_plan(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_token_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_orc.write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"),
                                  public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.token_spans(spark, path)


@query("op7_viterbi_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = viterbi_pieces.encode_texts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return rows.select("doc_id", "n_tokens", F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), "round_trip")


@query("op8_fm_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.drop_repeats(table(spark, sf_dir, "documents"))


@query("op9_quality_qda")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS mask,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before, filter_order[1:step] AS upto
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
r AS (SELECT part, filter_order, step, f,
  coalesce(sum(n) FILTER (WHERE translate(mask, upto, '') = mask), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') <> mask), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE contains(mask, f) AND translate(mask, before, '') = mask), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Said by both turns of conversation -1, which the query adds: control strings of its own template.
CONTROL_TURN = "</s>[INST] ok [/INST]"


@query("op12_chat_format", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'),
e AS (SELECT *, length(regexp_replace(text, '{chat_format.CONTROL}', '\1\\\2\3', 'g')) AS n, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 16 + strlen(url_encode(role)) END))::BIGINT AS formatted_chars,
  false AS rewrites, false AS far_history
FROM e GROUP BY conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)],
                                 "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(both)
    path = chat_format.format_conversations(rows, scratch_path(spark, "chat"))
    return chat_format.conversation_digests(chat_format.formatted_blocks(spark, path))


@query("op13_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2),
total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
c AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM s)),
sc AS (SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner2 AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM s WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner2 i ON i.lang = best.lang AND i.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM top JOIN total USING (lang) WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
