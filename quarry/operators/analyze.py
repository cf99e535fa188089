"""Per-document metadata (R7): the nine analysis fields for a whole corpus.

All fields are column expressions over the document text (one narrow pass,
no shuffle). A pluggable ``extract`` callable can replace the defaults
through ``quarry.operators.infer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import exprs as X

# Stop words used for the language vote (order = tie order).
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "on", "are", "with", "as",
           "this", "be", "at", "by", "from", "or"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "du", "est", "que", "qui", "dans", "pour", "pas",
           "sur", "au", "aux", "avec", "ce", "il"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich",
           "des", "auf", "im", "dem", "für", "auch", "es"],
    "es": ["el", "los", "las", "del", "y", "un", "una", "que", "es", "por", "con", "para", "no", "se",
           "al", "lo", "como", "su", "más", "la"],
}
# Tone lexicon.
POSITIVE = ["good", "great", "excellent", "positive", "success", "happy", "benefit", "improve", "best", "win"]
NEGATIVE = ["bad", "poor", "negative", "failure", "sad", "loss", "risk", "worse", "worst", "problem"]
DATE_RE = r"\b((19|20)\d{2}-\d{2}-\d{2})\b"
AUTHOR_RE = r"(?m)^\s*(?:Author|By)\s*:\s*(.+?)\s*$"
PUBLISHER_RE = r"(?m)^\s*Publisher\s*:\s*(.+?)\s*$"
PAGE_MARK_RE = r"--- Page \d+ ---"


def _count_in(low_text, words):
    """Occurrences of any of ``words`` as a whole token of the lower-cased
    text (a token is a maximal letter/digit run). One regex scan, no token
    array: the look-arounds make a match equal to a full token."""
    alt = "|".join(sorted(words, key=len, reverse=True))
    return F.regexp_count(low_text, F.lit(r"(?<![\p{L}\p{N}])(?:" + alt + r")(?![\p{L}\p{N}])"))


def language_vote(counts: dict):
    """Language with most stop-word hits (``counts``: lang -> count column);
    ties resolved in STOP_WORDS order; no hit -> NULL."""
    scores = [(lang, counts[lang]) for lang in STOP_WORDS]
    best = F.greatest(*[s for _l, s in scores])
    out = F.lit(None).cast("string")
    for lang, s in reversed(scores):
        out = F.when((s == best) & (best > 0), F.lit(lang)).otherwise(out)
    return out


def sentences(text):
    parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?]) ")
    return F.filter(F.transform(parts, lambda s: X.strip(s)), lambda s: s != "")


def extract_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    low = F.lower(t)
    # counts first, as columns: each regex scan runs once per document
    cnt = {f"_n_{lang}": _count_in(low, words) for lang, words in STOP_WORDS.items()}
    cnt["_pos"], cnt["_neg"] = _count_in(low, POSITIVE), _count_in(low, NEGATIVE)
    docs = docs.select("*", *[c.alias(n) for n, c in cnt.items()])
    lines = F.filter(F.transform(F.split(t, "\n"), lambda l: X.strip(l)), lambda l: l != "")
    pos, neg = F.col("_pos"), F.col("_neg")
    marks = F.size(F.regexp_extract_all(t, F.lit(PAGE_MARK_RE), 0))
    author = F.regexp_extract(t, AUTHOR_RE, 1)
    publisher = F.regexp_extract(t, PUBLISHER_RE, 1)
    dates = F.regexp_extract_all(t, F.lit(DATE_RE), 1)
    return docs.select(
        "*",
        F.get(lines, 0).alias("title"),
        F.slice(sentences(t), 1, 3).alias("summary"),
        F.when(author != "", F.array(author)).otherwise(F.array().cast("array<string>")).alias("author"),
        F.get(dates, 0).alias("date_created"),
        F.get(dates, F.size(dates) - 1).alias("last_modified_date"),
        F.nullif(publisher, F.lit("")).alias("publisher"),
        language_vote({lang: F.col(f"_n_{lang}") for lang in STOP_WORDS}).alias("language"),
        F.when(marks > 0, marks).alias("page_count"),
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral").alias("sentiment_tone")) \
        .drop(*cnt)
