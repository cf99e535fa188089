"""The training-data operators against brute force on a small hard fixture:
nulls in every column, empty and very long texts, ties, repeated rows and extra
columns whose names clash with the operators' own."""

import base64
import collections
import hashlib
import json
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bloom_lm, exact_dedup, fm_dedup, line_quality, mixing, qda, simhash, token_orc, viterbi_pieces, warc
from quarry.llm.queries import TOKENIZERS

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n string, hash string, kept string, "
          "fp string, start string, words string, copies string, size string, ids string, x string")


def make_rows():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return "".join(w + rnd.choice("    \n\t") for w in rnd.choices(vocabulary, k=n))
    passage = prose(60)
    rows = [(i, prose(rnd.randint(0, 120)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, prose(rnd.randint(3, 30)) + passage + prose(rnd.randint(3, 30)), "fr", "s0") for i in range(25)]
    long_text = prose(30_000)
    rows += [(200, long_text, "en", "s1"), (201, long_text.upper(), None, "s2"), (202, long_text + " tail", "de", None)]
    rows += [(300 + i, rows[5][1], "en", "s0") for i in range(8)] + [(310, rows[5][1].upper(), "en", "s1")]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " \n\t", "en", "s0"), (403, "x " * 500, "en", "s3"),
             (404, "ÀÉ #$% 12 <|endoftext|> ▁ a b c \x0b\x0c z", "en", "s3"), (405, "one two", "en", "s3")]
    rows += [(None, "no id here", "en", "s0"), rows[0], rows[0], (None, None, None, None)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None, "a", "b", "c", "d", "e", "f", "g", "h", "i", "j") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- quality rules

def base_brute(t):
    words = (t or "").encode().split()
    text = [w.decode() for w in words]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    many = collections.Counter(grams)
    covered = {j for k, g in enumerate(grams) if many[g] > 1 for j in range(k, k + 5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, text)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_base_rules(docs):
    got = line_quality.base_rules(docs).drop("t_hash")
    assert as_rows(got) == sorted(((i, *base_brute(t)) for i, t, _, _ in ROWS), key=repr)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    body = "these are the words of a menu that is on every page"
    rows = [(i, f"{body} {i}\n{body}\n" + (f"a longer story number {chr(97 + i % 26)}{chr(97 + i // 26)} " * 4 if i < 5 else ""), "h")
            for i in range(30)] + [(99, f"{body}\nelsewhere it stays and has some more words", "other")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality.line_quality(d, min_docs=10, max_share=0.2, min_left=0.3).collect()}
    assert got[0].n_removed_lines == 1 and got[99].n_removed_lines == 0 and got[99].kept
    texts = {r.doc_id: r.text for r in line_quality.cleaned_texts(d, min_docs=10, max_share=0.2).collect()}
    assert body + "\n" not in texts[0] and texts[0].startswith(f"{body} 0") and texts[99].startswith(body)
    for r in got.values():
        assert r.kept == (not r.base_failed and 1 - r.removed_share >= 0.3)


def test_copies_do_not_make_lines_frequent(spark):
    rows = [(i, "a line that is in many exact copies of one and the same document", "h") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_quality.line_quality(d).where("kept").count() == 50


# ---- mixing

def mix_brute(rows):
    size = [len((t or "").encode().split()) for _, t, _, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = left / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if weight[s] * level > 3 * total[s]}
        if more == capped:
            return size, {s: min(3.0 * total[s], weight[s] * level) for s in sources}, total
        capped = more


def test_mixing(docs):
    size, target, total = mix_brute(ROWS)
    out = mixing.mix_documents(docs).collect()
    assert sorted(((r.doc_id, r.size, r.source_size) for r in out), key=repr) == sorted(
        ((r[0], n, total[r[3]]) for n, r in zip(size, ROWS)), key=repr)
    for s, want in target.items():
        mine = [r for r in out if r.source == s]
        assert all(math.isclose(r.target, want) and 0 <= r.copies <= 3 for r in mine)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - want) <= max(r.size for r in mine)
    assert as_rows(mixing.mix_documents(docs.repartition(3))) == sorted(map(tuple, out), key=repr)


def test_mixing_is_nested(spark):
    d = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    few, many = ({r.doc_id: r.copies for r in mixing.mix_documents(d, weights=w).collect()} for w in ((1, 3), (2, 3)))
    assert all(few[i] <= many[i] for i in few if i % 2 == 0)


def test_mixing_meets_targets_where_many_rows_have_no_id(spark):
    rows = [(i if i % 2 else None, f"w{i} " * (i % 9 + 1), f"s{i % 2 if i < 60 else i % 3}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(d).collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= max(r.size for r in mine)
    assert as_rows(mixing.mix_documents(d.repartition(5))) == sorted(map(tuple, out), key=repr)


# ---- exact dedup

@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: F.length(norm)])
def test_exact_dedup_decides_by_content(docs, digest):
    groups = collections.defaultdict(list)
    for i, t, _, _ in ROWS:
        groups[lower(t)].append(i)
    want = []
    for i, t, _, _ in ROWS:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    got = exact_dedup.exact_groups(docs, salts=3, digest=digest).drop("digest")
    assert as_rows(got) == sorted(want, key=repr)


# ---- language model

def test_bloom_lm(docs):
    rule = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0

    def learned(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    counts, pairs = collections.Counter(), collections.Counter()
    for i, t, _, _ in ROWS:
        if learned(i):
            w = [*lower(t).split(), None]
            counts.update(w)
            pairs.update(zip(["start", *w[:-1]], w))
    n, v = sum(counts.values()), len(counts)
    d = n + 0.1 * (v + 1)
    starts = sum(learned(i) for i, *_ in ROWS)
    want = []
    for i, t, _, _ in ROWS:
        w = [*lower(t).split(), None]
        score = 0
        for a, b in zip(["start", *w[:-1]], w):
            c, ca = pairs[a, b], starts if a == "start" else counts[a]
            q = math.frexp(c)[1]
            c = min((2 ** (q - 1) + 2 ** q - 1) / 2 if c else 0, ca, counts[b])
            score += math.log10(0.7 * (counts[b] + 0.1) / d + (0.3 * c / ca if c else 0))
        want.append((i, learned(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / d) for x in w), score))
    want.sort(key=repr)
    for options in ({"bits_per_token": 30}, {"bits_per_token": 30, "hot_words": 20}, {"bits_per_token": 30, "max_filter": 1 << 15}):
        got = as_rows(bloom_lm.score_texts(docs, rule, **options))
        assert [g[:5] for g in got] == [x[:5] for x in want]
        assert np.allclose([g[5] for g in got], [x[5] for x in want], rtol=1e-9)
        assert np.allclose([g[6] for g in got], [x[6] for x in want], rtol=0.02)


def test_bloom_levels_never_read_low():
    keys = np.random.default_rng(1).integers(0, 2 ** 63, 3000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 5000, 3000)
    blocks = 3
    bits = np.zeros(blocks << (bloom_lm.BLOCK_BITS - 3), np.uint8)
    for at, x in bloom_lm.filled_blocks(keys, counts, blocks):
        bits[at << (bloom_lm.BLOCK_BITS - 3):(at + 1) << (bloom_lm.BLOCK_BITS - 3)] = np.frombuffer(x, np.uint8)
    got = bloom_lm.stored_levels(bits, keys, bloom_lm.block_of(keys, blocks))
    assert (got >= bloom_lm.levels_of(counts)).all() and (got == bloom_lm.levels_of(counts)).mean() > 0.99
    other = np.random.default_rng(3).integers(0, 2 ** 63, 3000).astype(np.uint64)
    assert (bloom_lm.stored_levels(bits, other, bloom_lm.block_of(other, blocks)) > 0).mean() < 0.02


# ---- WARC

def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "é" * 5000, "<p>a</p>", "<p>a</p>", ""]
    rows = [(7 - k, None if k == 3 else f"http://h/{k} x\r\n", t, "y") for k, t in enumerate(html)] + [(None, None, "<p>a</p>", "y")]
    rows += [(100 + k, f"http://h/{k}", os.urandom(600).hex(), "y") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    path = warc.write_archives(warc.archive_plan(pages), str(tmp_path / "w"), roll_bytes=20_000, shards=3)
    by = collections.defaultdict(list)
    for i, _, t, _ in rows:
        if i is not None:
            by[t or ""].append(i)
    want = []
    for i, _, t, _ in rows:
        body, first = (t or "").encode(), min(by[t or ""])
        want.append((i, first if i != first else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "revisit" if i != first else "response"))
    got = warc.read_archives(spark, path, with_payload=True)
    assert as_rows(got.drop("url", "payload")) == sorted(want, key=repr)
    payload = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert all(payload[i] == (t or "") for i, _, t, _ in rows if i in payload)
    manifest = [json.loads(x) for x in open(f"{path}/_manifest.jsonl")]
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 6 and not os.path.exists(f"{path}/_temporary/x")
    for m in manifest:
        data = open(f"{path}/{m['file']}", "rb").read()
        assert len(data) == m["bytes"] and hashlib.sha256(data).hexdigest() == m["sha256"]
    again = warc.write_archives(warc.archive_plan(pages), str(tmp_path / "v"), roll_bytes=20_000, shards=3)
    assert open(f"{again}/_manifest.jsonl").read() == open(f"{path}/_manifest.jsonl").read()
    large = warc.archive_plan(pages, min_payload=1000)
    assert large.where("refers_to is not null").count() == 0


def test_warc_writes_the_same_files_whatever_the_partitions(spark, tmp_path):
    rows = [(k * 7919 % 20011 if k % 5 else None, f"u{k % 3}", f"<p>{k % 9000}</p>", 1) for k in range(20_000)]
    rows += [(3, "u", "same", 1)] * 3500  # a sixth of the table is one row
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    paths = [warc.write_archives(warc.archive_plan(p), str(tmp_path / name), roll_bytes=100_000, shards=6)
             for name, p in (("a", pages.repartition(3)), ("b", pages.repartition(11, "html")))]
    manifests = [open(f"{p}/_manifest.jsonl").read() for p in paths]
    assert manifests[0] == manifests[1]
    records = [int(json.loads(line)["records"]) for line in manifests[0].splitlines()]
    by_range = collections.Counter()
    for line in map(json.loads, manifests[0].splitlines()):
        by_range[line["file"][:11]] += line["records"]
    assert sum(records) == len(rows) and max(by_range.values()) < len(rows) / 3 and len(by_range) == 6
    uris = []
    for line in map(json.loads, manifests[0].splitlines()):
        heads = [warc.parsed(m)[0] for m in warc.members(open(f"{paths[0]}/{line['file']}", "rb").read())]
        uris += [(h["WARC-Record-ID"], h.get("WARC-Refers-To")) for h in heads if h["WARC-Type"] != "warcinfo"]
    assert len({u for u, _ in uris}) == len(rows) and {r for _, r in uris if r} <= {u for u, _ in uris}


def test_warc_reads_only_what_the_manifest_names(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(50)], "page_id long, url string, html string")
    path = warc.write_archives(warc.archive_plan(pages), str(tmp_path / "w"), roll_bytes=2000, shards=2)
    files = [m["file"] for m in warc.manifest_of(path)]
    data = open(f"{path}/{files[0]}", "rb").read()
    open(f"{path}/stray.warc.gz", "wb").write(data)
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(50))
    open(f"{path}/{files[0]}", "wb").write(open(f"{path}/{files[-1]}", "rb").read())
    with pytest.raises(Exception, match="another size|differs from the manifest"):
        warc.read_archives(spark, path).collect()
    none = warc.write_archives(warc.archive_plan(pages.limit(0)), str(tmp_path / "n"))
    assert warc.read_archives(spark, none).count() == 0
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, str(tmp_path / "missing"))


# ---- token ids

def test_token_orc(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    path = token_orc.write_tokens(docs, str(tmp_path / "orc"), f"{TOKENIZERS}/word_bpe_49k.json")
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x, _, _ in ROWS]
    crc = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids]
    got = token_orc.token_spans(spark, path).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(crc, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    one = token_orc.read_tokens(spark, path).where("doc_id = 200")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,200)]" in one._jdf.queryExecution().toString()
    assert list(one.first().ids) == dict(ids)[200]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_give_the_ids_of_whole_texts(seed):
    rnd = random.Random(seed)
    e = token_orc.StretchEncoder(f"{TOKENIZERS}/word_bpe_49k.json")
    letters = "aZ'sé́Σßİ9 \t\n\r\x0b\x0c\x1c\x85  .,!<|endoftext|>中"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(400)]
    texts += [" ".join("".join(rnd.choices("abcdeinrstABXYZ", k=rnd.randint(1, 14))) + rnd.choice(["", ".", "'s", "|"]) for _ in range(90)) for _ in range(60)]
    assert [x.tolist() for x in e.encode([x.encode() for x in texts])] == [e.whole(x) for x in texts]


def test_words_that_were_let_go_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_orc, "ROOM", 5)
    e = token_orc.StretchEncoder(f"{TOKENIZERS}/word_bpe_49k.json")
    for k in range(40):
        text = " ".join(f"word{j}" for j in range(k % 7, k % 7 + 4))
        assert [x.tolist() for x in e.encode([text.encode(), b"", b"\n| a|b"])] == [e.whole(text), [], e.whole("| a|b")]
    assert len(e.known) < 12 and e.encode([]) == []


def test_files_go_by_their_number(spark):
    names = [f"part-{n:05d}-x.zstd.orc" for n in (99_999, 100_000, 7, 100_001)]
    got = spark.createDataFrame([(n,) for n in names], "file string").orderBy(token_orc.part_number(F.col("file")))
    assert [r.file[5:11] for r in got.collect()] == ["00007-", "99999-", "100000", "100001"]


# ---- SentencePiece

def whole_viterbi(model, text):
    best, back = [0.0] + [None] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            if best[start] is None:
                continue
            piece = text[start:end]
            cost = model.scores[piece][1] if piece in model.scores else model.floor if end - start == 1 else None
            if cost is not None and (best[end] is None or best[start] + cost > best[end]):
                best[end], back[end] = best[start] + cost, start
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    cuts.reverse()
    return [i for a, b in zip(cuts, cuts[1:]) for i in model.ids_of(text[a:b])]


@pytest.mark.parametrize("seed", range(4))
def test_streaming_viterbi_equals_whole_text_viterbi(seed):
    rnd = random.Random(seed)
    names = {"".join(rnd.choices("ab▁", k=rnd.randint(1, 6))) for _ in range(25)} | {"a", "b"}
    model = viterbi_pieces.Pieces(scores={p: (k + 3, float(-rnd.randint(1, 9))) for k, p in enumerate(sorted(names))})
    for _ in range(60):
        text = "".join(rnd.choices("aab▁c", k=rnd.randint(1, 300)))
        cut = sorted(rnd.choices(range(len(text) + 1), k=3))
        chunks = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]
        assert [i for part in model.stream(chunks) for i in part] == whole_viterbi(model, text) == model.short(text)


def test_window_stays_small():
    model = viterbi_pieces.pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    text = "".join(random.Random(1).choices("abcdefgh", k=20_000))
    assert [i for part in model.stream([text]) for i in part] == whole_viterbi(model, text)
    assert model.window < 40 * model.longest


def test_sentencepiece_round_trip(docs):
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = viterbi_pieces.encode_texts(docs, path).collect()
    text = {i: t or "" for i, t, _, _ in ROWS if i is not None}
    model = viterbi_pieces.pieces(path)
    assert len(out) == len(ROWS) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    for r in out:
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert list(r.ids) == (whole_viterbi(model, "▁" + t.replace(" ", "▁")) if t else [])
            assert sp.decode(list(r.ids)) == t.replace("▁", " ")
    back = viterbi_pieces.decode_ids(viterbi_pieces.encode_texts(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id is not None} == {i: t.replace("▁", " ") for i, t in text.items()}


# ---- substring dedup

def repeats_brute(rows, window=20):
    places = sorted({(fm_dedup.NULL_ID if i is None else i, t or "") for i, t, _, _ in rows})
    first, out = {}, {}
    spots = sorted((i, k, tuple(w[k:k + window])) for i, t in places for w in [t.encode().split()] for k in range(len(w) - window + 1))
    for i, k, key in spots:
        first.setdefault(key, (i, k))
    for i, t in places:
        w = t.encode().split()
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < (i, k) for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_fm_dedup(docs, hot):
    unique = [r for r in ROWS if r[0] is not None]
    want = repeats_brute(unique)
    got = fm_dedup.drop_repeats(docs.where("doc_id is not null"), hot=hot, shard=50)
    assert as_rows(got) == sorted(((i, *want[i, t or ""]) for i, t, _, _ in unique), key=repr)


def test_fm_dedup_returns_the_kept_words_and_takes_null_ids(docs):
    out = fm_dedup.drop_repeats(docs, with_text=True).collect()
    assert len(out) == len(ROWS) and sum(r.doc_id is None for r in out) == 2
    for r in out:
        if r.text is not None:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and len(r.text.split(" ")) >= r.n_words - r.n_removed


def signed_hash(t):
    import xxhash
    return simhash.signed(xxhash.xxh64_intdigest((t or "").encode(), 42))


def rows_brute(rows, window):
    """(doc_id, n_words, n_removed, hash of the kept words): each text of an id
    is a document, and so is each row without an id."""
    docs = collections.Counter((i is not None, i or 0, signed_hash(t), t or "") for i, t in rows)
    seen, out = set(), []
    for (known, i, _, t), n in sorted(docs.items()):
        w = t.encode().split()
        for _ in range(1 if known else n):
            gone = set()
            for k in range(len(w) - window + 1):
                if (key := tuple(w[k:k + window])) in seen:
                    gone |= set(range(k, k + window))
                seen.add(key)
            kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
            out += [(i if known else None, len(w), len(gone), hashlib.sha256(kept).hexdigest())] * (n if known else 1)
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2048, 2])
def test_fm_dedup_null_and_shared_ids(spark, hot):
    rnd = random.Random(11)
    passages = [" ".join(rnd.choices("abcdefgh", k=24)) for _ in range(4)]

    def text():
        return " ".join(rnd.choices("ijklmnop", k=rnd.randint(0, 30))) + " " + rnd.choice([*passages, ""]) + " " + " ".join(
            rnd.choices("ijklmnop", k=rnd.randint(0, 30)))
    whole = text() + " " + passages[0]
    rows = [(None, text()) for _ in range(15)] + [(None, whole)] * 3 + [(None, "a short text")] * 2 + [(None, None), (None, "")]
    rows += [(7, text()) for _ in range(15)] + [(7, whole), (8, whole), (8, whole), (0, text()), (-5, text())]
    rows += [(9, None), (9, " "), (9, text())]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fm_dedup.drop_repeats(d, hot=hot, shard=5, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in out), key=repr) == rows_brute(rows, fm_dedup.WINDOW)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in out if r.text is not None)
    assert all(r.n_removed == 0 for r in out if r.text is None)


@pytest.mark.parametrize("bits", [fm_dedup.FILTER_BITS, 1])
def test_fm_dedup_takes_ids_whose_hash_is_zero(spark, bits):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(25317696, text + " x"), (25317697, "y " + text)]  # the first id's hash is 0 of 2**24; with one bit, every hash is
    got = fm_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert {r.doc_id: r.n_removed for r in got} == {25317696: 0, 25317697: 30}


def test_fm_index_counts_and_matching_statistics():
    rnd = np.random.default_rng(5)
    text = np.concatenate([np.append(rnd.integers(1, 4, n), 0) for n in (30, 50, 5, 80)])
    index = fm_dedup.FmIndex(text, depth=200)
    ends = np.flatnonzero(text)
    length, _, _ = fm_dedup.matching_statistics(index, text, ends, 12)
    flat = ["".join(map(str, x)) for x in [text.tolist()]][0]
    for e, n in zip(ends, length):
        want = 0
        for k in range(1, 13):
            p = flat[e - k + 1:e + 1] if e - k + 1 >= 0 else "0"
            if "0" in p or sum(flat.startswith(p, i) for i in range(len(flat))) < 2:
                break
            want = k
        assert n == want


# ---- quality classifier

def test_qda(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "y"))
        labels.append((i, int(good)))
    rows += [(1000, None, "y"), (1001, "", "y"), (1002, "w " * 50_000, "y"), rows[0]]
    labels += [(1000, None), (2000, 1), (0, 1), (1, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, x string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    got = qda.quality_scores(d, y).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    none = qda.quality_scores(d, y.where("quality = 5")).collect()
    assert {r.score for r in none} == {0.5}


def test_qda_matches_direct_formula():
    rng = np.random.default_rng(0)
    mean, cov = rng.normal(size=3), np.diag([1.0, 2.0, 0.5])
    low = np.linalg.cholesky(cov)
    part = (mean, np.linalg.inv(low), float(-np.log(np.diag(low)).sum()), math.log(0.5))
    flat = (np.zeros(3), np.eye(3), 0.0, math.log(0.5))
    m = qda.Discriminant(np.zeros(3), np.ones(3), {1: part, 0: flat}, temperature=1.0)
    x = rng.normal(size=(5, 3))

    def log_density(x, mu, c):
        return -0.5 * (x - mu) @ np.linalg.inv(c) @ (x - mu) - 0.5 * np.log(np.linalg.det(c))
    want = [log_density(v, mean, cov) - log_density(v, np.zeros(3), np.eye(3)) for v in x]
    assert np.allclose(m.log_odds(x), want)


# ---- SimHash

def simhash_brute(t):
    import xxhash
    w = lower(t).split()
    grams = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps, radius):
    keys = sorted(set(fps))
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


def test_simhash(docs):
    fps = {(i, t): simhash_brute(t) for i, t, _, _ in ROWS}
    roots = components_brute(fps.values(), 2)
    least = collections.defaultdict(list)
    for (i, _), f in fps.items():
        if i is not None:
            least[roots[f]].append(i)
    want = [(i, f"{fps[i, t]:016x}", min(least[roots[fps[i, t]]], default=None)) for i, t, _, _ in ROWS]
    assert as_rows(simhash.simhash_groups(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize(("radius", "group"), [(2, 4096), (2, 8), (3, 16)])
def test_simhash_links_lose_no_component(spark, radius, group):
    rng = random.Random(radius + group)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(seeds)
    for s in seeds[:12]:
        for _ in range(30):  # chains and clouds around some of them
            for _ in range(rng.randint(1, 3)):
                s ^= 1 << rng.randrange(64)
            fps.add(s)
    low = rng.getrandbits(40)
    fps |= {low ^ (rng.getrandbits(6) << 40) for _ in range(60)}  # a hot key: many agree on most bits
    fps = sorted(fps)
    signed = [simhash.signed(f) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, radius, group)).collect()}
    brute = components_brute(fps, radius)
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, s in zip(fps, signed):
        got[roots.get(s, s)].add(f)
        want[brute[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{k: 0 for k in range(1, 61)}, 101: 100}


# ---- empty tables, and the pipeline

def test_empty_tables(empty, spark, tmp_path):
    rule = F.col("doc_id") >= 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outs = [line_quality.line_quality(empty), mixing.mix_documents(empty), exact_dedup.exact_groups(empty),
            bloom_lm.score_texts(empty, rule), fm_dedup.drop_repeats(empty), qda.quality_scores(empty, labels),
            simhash.simhash_groups(empty), viterbi_pieces.encode_texts(empty, f"{TOKENIZERS}/piece_bpe_32k.model"),
            token_orc.token_spans(spark, token_orc.write_tokens(empty, str(tmp_path / "o"), f"{TOKENIZERS}/word_bpe_49k.json")),
            warc.read_archives(spark, warc.write_archives(warc.archive_plan(pages), str(tmp_path / "w")))]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_pipeline_stages(docs, spark, tmp_path):
    import corpus_pipeline as p

    labels = [(i, int(bool(t) and len(t) > 20 and "#" not in t)) for i, t, _, _ in ROWS if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").dropDuplicates().write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, step) in enumerate(p.STAGES):
        before = collections.Counter((r.doc_id, r.text) for r in cur.collect())
        out = step(spark, cur, str(tmp_path))
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            after = collections.Counter((r.doc_id, r.text) for r in out.collect())
            assert set(after) <= set(before)
        if name == "quality_classifier":
            scores = {r.doc_id: r.predicted for r in qda.quality_scores(cur, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
            assert after == collections.Counter({x: n for x, n in before.items() if scores[x[0]] == 1})
        elif name == "exact_dedup":
            best = collections.defaultdict(list)
            for i, t in before:
                best[lower(t)].append(-1 if i is None else i)
            assert set(after) == {(i, t) for i, t in before if (-1 if i is None else i) == max(best[lower(t)])}
        elif name == "simhash_near_dedup":
            roots = components_brute([simhash_brute(t) for _, t in before], 2)
            groups = collections.defaultdict(list)
            for i, t in before:
                groups[roots[simhash_brute(t)]].append(i)
            assert sorted(i for i, _ in after) == sorted(min(g) for g in groups.values())
        elif name == "mix_sources":
            assert max(after.values(), default=0) <= 3 * max(before.values(), default=1) and sum(after.values()) > 0
        else:
            rows = out.collect()
            assert collections.Counter(r.doc_id for r in rows) == collections.Counter(
                i for (i, _), n in before.items() for _ in range(n)) and all(r.round_trip for r in rows)
        out.write.parquet(f"{tmp_path}/{name}")
        cur = spark.read.parquet(f"{tmp_path}/{name}")


def test_pipeline_decides_on_rows_of_null_and_shared_ids(spark, tmp_path):
    import corpus_pipeline as p

    rnd = random.Random(5)

    def good():
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(30)) + "."

    def bad():
        return " ".join(w.upper() + "!!" for w in good().split())

    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    train = [(i, good() if i % 2 else bad(), "s0") for i in range(200)]
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(train + [(i, f(), "s0") for i in (None, 500) for f in (good, bad, bad)])
    scores = qda.quality_scores(docs, labels).where("predicted = 1").collect()
    out = p.quality(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r.doc_id for r in scores)
    assert [sum(r.doc_id == i for r in out) for i in (None, 500)] == [1, 1]

    a, b, c, d = (good() for _ in range(4))
    near = d + " end"
    rows = [(None, a, "s0"), (None, a.upper(), "s0"), (None, a, "s1"), (None, b, "s0"), (1, b, "s0"), (1, c, "s0"), (1, c, "s0"),
            (2, c, "s0"), (2, a + " x", "s0"), (3, d, "s0"), (3, d, "s0"), (None, None, "s0"), (None, "", "s0")]
    out = [(r.doc_id, lower(r.text)) for r in p.exact(spark, frame(rows), str(tmp_path)).collect()]
    want = [(None, a), (1, b), (2, c), (2, a + " x"), (3, d), (None, "")]
    assert sorted(out, key=repr) == sorted(((i, lower(t)) for i, t in want), key=repr)

    rows += [(None, near, "s0"), (1, near, "s0")]
    roots = components_brute([simhash_brute(t) for _, t, _ in rows], 2)
    group = lambda t: roots[simhash_brute(t)]
    out = [(r.doc_id, group(r.text)) for r in p.near(spark, frame(rows), str(tmp_path)).collect()]
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        ids[group(t)] += [i] * (i is not None)
    assert sorted(out, key=repr) == sorted(((min(x, default=None), g) for g, x in ids.items()), key=repr)

    rows = [(i, good(), f"s{k % 3}") for i in (None, 7) for k in range(120)]
    _, target, _ = mix_brute([(i, t, "en", s) for i, t, s in rows])
    out = p.mix(spark, frame(rows), str(tmp_path)).collect()
    for s, want in target.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - want) <= 30
