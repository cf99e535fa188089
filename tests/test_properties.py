"""Property tests: chunking coverage, number formatting and audit, diffs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.corpus import split_recursive

WORDS = st.lists(st.text(alphabet="abcdeéß xyz\n", min_size=0, max_size=40), min_size=0, max_size=120)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(min_value=20, max_value=300))
def test_recursive_chunks_bounded_and_cover_text(parts, size):
    text = " ".join(parts)
    overlap = size // 5
    chunks = split_recursive(text, size, overlap)
    assert all(len(c) <= size for c in chunks)
    words = text.split()
    it = iter(" ".join(chunks).split())
    assert all(any(w == x for x in it) for w in words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=20))
def test_fmt_num_matches_python_and_passes_audit(xs):
    from quarry.session import get_session
    spark = get_session("local[4]", shuffle_partitions=4, app="quarry-tests")
    from pyspark.sql import functions as F

    from quarry.functions import exprs as X
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = df.select("x", X.fmt_num(F.col("x")).alias("s"),
                     X.verify_numbers(X.fmt_num(F.col("x")), F.array(F.round("x", 2))).alias("ok")).collect()
    for r in rows:
        want = f"{int(r.x):,}" if r.x == int(r.x) else f"{r.x:,.2f}"
        assert r.s == want
        assert r.ok


def test_verify_numbers_cases(spark):
    from pyspark.sql import functions as F

    from quarry.functions import exprs as X
    df = spark.createDataFrame([("Total is 1,234.50 units.", [1234.5], True), ("Total 12", [13.0], False),
                                ("nothing", [], True), ("-3.", [-3.0], True)],
                               "t string, a array<double>, want boolean")
    for r in df.select(X.verify_numbers(F.col("t"), F.col("a")).alias("got"), "want").collect():
        assert r.got == r.want
