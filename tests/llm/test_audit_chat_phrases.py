"""Filter audit, chat formatting and phrase mining against brute force: nulls,
empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.llm import chat_format, collocations, filter_audit
from quarry.llm.queries import CONTROL_TURN
from quarry.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file's templates

DOCS = "doc_id long, text string, lang string, source string, mask int, digest string, part string, n long, phrase string, k int, h long"
rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choices("abÉß", k=rnd.randint(1, 3))) for _ in range(25)] + ["Ab", "#x", "CAPS"]


def prose(n):
    return "".join(w + rnd.choice(["  ", " ", " ", "\t", "\n", ". ", "\x0b", ", "]) for w in rnd.choices(VOCABULARY, k=n))


def doc_rows():
    texts = [prose(rnd.choice([0, 3, 40, 190, 260, 400])) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, rnd.choice(texts), rnd.choice(["en", "fr"])) for i in range(40)]
    rows += [(None, texts[0], "en"), (None, None, None), (200, None, None), (201, "", "en"), (202, " \n", "en"), rows[3], rows[3], rows[3]]
    rows += [(300, prose(30_000), "en"), (-5, texts[1], "de"), (205, "a b ÀÉ .;. x", "en"), (7, texts[2], "en")]
    return rows


ROWS = doc_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, None, 1, "a", "b", 2, "c", 3, 4) for i, t, lang in ROWS], DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- filter interaction audit

LABELS = [(i, rnd.randint(0, 1), rnd.choice([0, 0, 1, None])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (100, None, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, n int")


def masks_brute():
    good, toxic = ({i for i, *v in LABELS if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in ROWS:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = collections.defaultdict(lambda: [0, 0, 0])
    for i, t, lang in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        for k, v in enumerate((1, i in good, i in toxic)):
            out[lang or "", sum(f << k for k, f in enumerate(fails))][k] += v
    return out


def audit_brute(counts, names):
    bit = {f: 1 << k for k, f in enumerate(names)}
    rows, shapley = [], collections.Counter()
    for order in itertools.permutations(names):
        for s, f in enumerate(order):
            before = sum(bit[g] for g in order[:s])
            gone = [c for m, c in counts.items() if m & bit[f] and not m & before]
            fails = sum(c[0] for m, c in counts.items() if m & bit[f])
            n, good, toxic = (sum(c[k] for c in gone) for k in range(3))
            shapley[f] += n
            rows.append(("".join(order), s + 1, sum(c[0] for m, c in counts.items() if not m & (before | bit[f])), n, fails - n,
                         counts.get(bit[f], (0,))[0], good, toxic))
    return sorted((*r, shapley[r[0][r[1] - 1]]) for r in rows)


def test_filter_audit(docs, labels):
    want = collections.defaultdict(dict)
    for (part, m), c in masks_brute().items():
        want[part][m] = tuple(c)
    got = collections.defaultdict(list)
    for r in filter_audit.filter_audit(docs, labels).collect():
        got[r[0]].append(tuple(r)[1:])
    assert set(got) == set(want) == {"", "en", "de", "fr"}
    for part, counts in want.items():
        assert sorted(got[part]) == audit_brute(counts, "ABCDE")


def test_filter_audit_of_nothing(empty, labels, docs):
    assert filter_audit.filter_audit(empty, labels).isEmpty()
    assert filter_audit.filter_audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").isEmpty()


def test_filter_audit_with_other_rules(spark, docs, labels):
    rules = {"x": lambda text, words: b"a" in text, "y": lambda text, words: len(words) > 100}
    got = filter_audit.filter_audit(docs, labels, rules, part_col="source").collect()
    assert len(got) == 6 * 3 and {r.filter_order for r in got} == {"".join(p) for p in itertools.permutations("xyE")}
    assert len({r.kept for r in got if r.step == 3}) == 1


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_level_swaps_keep_the_diagram(n):
    names = "ABCDE"[:n]
    counts = {m: (rnd.randint(0, 3), rnd.randint(0, 2), rnd.randint(0, 1)) for m in range(1 << n) if rnd.random() < .7} or {0: (1, 0, 0)}
    diagram = filter_audit.Diagram(names, counts)
    orders = {names}
    for level in filter_audit.swaps(n):
        diagram.swap(level)
        orders.add("".join(diagram.order))
        again = filter_audit.Diagram(diagram.order, {  # made for this order from the start
            sum((m >> names.index(f) & 1) << k for k, f in enumerate(diagram.order)): c for m, c in counts.items()})
        assert [len(x) for x in diagram.levels] == [len(x) for x in again.levels]
        assert [[list(x) for x in s] for s in diagram.steps()] == [[list(x) for x in s] for s in again.steps()]
    assert len(orders) == len(list(itertools.permutations(names)))


def test_diagram_shares_equal_parts():
    diagram = filter_audit.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})
    assert [len(x) for x in diagram.levels] == [1] * 5 and diagram.weight[diagram.root][0] == 32


# ---- chat formatting

CHAT = "conv_id long, turn long, role string, text string, block long, at long, own boolean, segment long, far_history string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "[", "<", "<<s>", "[/INST", "\\", "[TURN:a] b [/TURN]", "[TURN:] ]", "x\ny ", " ", "",
         "<s>[SYS] z [/SYS]", "a</s", ">", "", None]


def chat_rows():
    rows = []
    for c in range(30):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool [x]", "é", None]),
                         "".join(rnd.choice(NASTY) or "" for _ in range(rnd.randint(0, 4))) if rnd.random() < .9 else None))
    rows += [(50, t, ["user", "assistant"][t % 2], f"turn {t} {rnd.choice(NASTY)}") for t in range(333)]
    rows += [(51, 3 * t - 40, ["user", "assistant"][t % 2], prose(5)) for t in range(257)]
    rows += [(52, None if t < 3 else t // 40, ["assistant", "user"][t % 2], f"tie {t % 7}") for t in range(200)]
    rows += [(None, 0, "user", "who"), (None, 1, "assistant", "nobody"), (53, 1, "assistant", "same"), (53, 1, "assistant", "same"),
             (54, 0, "assistant", "long " * 200_000)]
    return rows


CONVERSATIONS = chat_rows()


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, 1, 2, False, 3, "x") for r in CONVERSATIONS], CHAT).repartition(5)


def turns_brute():
    out = collections.defaultdict(list)
    for c, t, role, text in CONVERSATIONS:
        out[c].append(((t is not None, t or 0), (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, r, t in sorted(v)] for c, v in out.items()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("segment", [64, 128, 1 << 20])
def test_chat_round_trip(spark, chats, segment):
    path = chat_format.format_conversations(chats, scratch_path(spark, "chat-test"), segment=segment)
    blocks = chat_format.formatted_blocks(spark, path)
    got = {r.conv_id: r for r in chat_format.conversation_digests(blocks).collect()}
    texts = collections.defaultdict(str)
    for r in sorted(blocks.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.block)):
        texts[r.conv_id] += r.text
    want = turns_brute()
    assert set(got) == set(want)
    for c, turns in want.items():
        whole = chat_format.inst_template(turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert texts[c] == whole and list(chat_format.read_inst(whole)) == turns
        assert tuple(got[c])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole), False, False)


def test_control_strings_in_texts_are_not_control_strings():
    for text in [CONTROL_TURN, *map("".join, itertools.product([x or "" for x in NASTY], repeat=2))]:
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not re.search(r"</?s>|\[/?(INST|SYS|TURN(:[^\]\s]*)?)\]", safe, re.ASCII) or "TURN:" in safe


def tagged(turns):
    return "".join(f"<|{r}|>{t}<|end|>" for r, t in turns)


def system_last(turns):
    """Moves the system text before the last user turn: rewrites history."""
    system = "".join(t for r, t in turns if r == "system")
    rest = [x for x in turns if x[0] != "system"]
    last = max((k for k, (r, _) in enumerate(rest) if r == "user"), default=-1)
    return "".join(("{" + system + "}" if k == last else "") + f"<{r}>{t}</{r}>" for k, (r, t) in enumerate(rest))


def numbered_turns(turns):
    """Writes each turn's number: depends on the whole history."""
    return "".join(f"({k}){r}:{t};" for k, (r, t) in enumerate(turns))


def first_quoted(turns):
    """Repeats the sixth turn in every later one: looks back further than any halo."""
    return "".join(f"<{r}>{t}|{turns[5][1] if k > 5 else ''}</{r}>" for k, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template", [tagged, system_last, numbered_turns, first_quoted])
@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_any_template_is_rebuilt_from_its_spans(spark, template, segment):
    rows = [(c, t, "system" if t == 0 else ["assistant", "user"][t % 2], f"c{c} t{t}") for c, n in ((1, 4), (2, 150), (3, 64)) for t in range(n)]
    path = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                                            scratch_path(spark, "chat-test"), template, segment)
    blocks = sorted(chat_format.formatted_blocks(spark, path).collect(), key=lambda r: (r.conv_id, r.block))
    digests = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.formatted_blocks(spark, path), None, str).collect()}
    for c, n in ((1, 4), (2, 150), (3, 64)):
        turns = [(r, t) for k, _, r, t in rows if k == c]
        out, loss = "", []
        mine = [b for b in blocks if b.conv_id == c]
        for b in mine:
            for p in b.turns:
                out = out[:len(out) - p.takes_back] + b.text[p.start:p.end]
                loss.append(b.text[p.loss_start:p.loss_end])
        assert out == template(turns)
        assert [x for x in loss if x] == [t for r, t in turns if r == "assistant"]
        assert any(b.rewrites for b in mine) == (template is system_last) == (digests[c].loss_chars is None)
        assert digests[c].far_history == (n > 64 and template in (numbered_turns, first_quoted, system_last))
        assert digests[c].formatted_chars == len(out) and digests[c].n_turns == n


def test_chat_of_nothing(spark, chats):
    path = chat_format.format_conversations(chats.where("false"), scratch_path(spark, "chat-test"))
    assert chat_format.conversation_digests(chat_format.formatted_blocks(spark, path)).isEmpty()


def recalling(turns):
    """A turn that says "recall" repeats the one 40 turns earlier."""
    return "".join(f"[{turns[i - 40][1] if t == 'recall' and i >= 40 else ''}|{t}]" for i, (_, t) in enumerate(turns))


def test_templates_that_look_far_back_at_a_single_turn_are_found(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "recall" if c and t == 80 else f"said {t}") for c in (0, 1) for t in range(200)]
    path = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                                            scratch_path(spark, "chat-test"), template=recalling)
    got = chat_format.formatted_blocks(spark, path).orderBy("conv_id", "block").collect()
    for c in (0, 1):
        mine = [r for r in got if r.conv_id == c]
        assert "".join(r.text for r in mine) == recalling([(r[2], r[3]) for r in rows if r[0] == c])
        assert any(r.far_history for r in mine) == bool(c)


def recalling_further(turns):
    """A turn that says "recall" repeats the one 150 turns earlier, further back than a segment of 64 and its context."""
    return "".join(f"[{turns[i - 150][1] if t == 'recall' and i >= 150 else ''}|{t}]" for i, (_, t) in enumerate(turns))


@pytest.mark.parametrize("template", [recalling_further, lambda turns: recalling_further(turns) + "."])  # the second takes back a character a turn
def test_templates_that_look_back_over_segments_are_found(spark, template):
    rows = [(c, t, "assistant" if t % 2 else "user", "recall" if c == 1 and t == 210 else f"said {t}") for c in (0, 1, None) for t in range(300)]
    path = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                                            scratch_path(spark, "chat-test"), template, segment=64)
    got = chat_format.formatted_blocks(spark, path).orderBy("conv_id", "block").collect()
    for c in (0, 1, None):
        mine = [r for r in got if r.conv_id == c]
        assert chat_format.made_up([(r.text, r.turns) for r in mine]) == template([(r[2], r[3]) for r in rows if r[0] == c])
        assert any(r.far_history for r in mine) == (c == 1 or template is not recalling_further)


def test_template_that_hides_a_text_is_refused():
    with pytest.raises(ValueError):
        list(chat_format.render_turns(lambda turns: "".join(sorted(t for _, t in turns)), [("user", "z")], [("assistant", "a" * 3)]))


# ---- phrase collocations

def phrases_brute(rows, least, longest, covered, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").encode().lower().decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = []
        longer = [p for p, c in counts.items() if c >= least and len(p) > 2]
        inner = collections.Counter()
        for p in longer:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i:i + k]] = max(inner[p[i:i + k]], counts[p])
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (inner[p] and 100 * inner[p] >= covered * a):
                score, _, left, right = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                some.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,rate", [(10, 3, 2000, 8), (3, 4, 40, 4), (2, 2, 7, 1), (3, 3, 2000, 10 ** 9)])
def test_collocations(docs, least, longest, top, rate):
    got = collocations.collocations(docs, least, longest, 50, top, rate, spread=3)
    assert sorted(tuple(r) for r in got.collect()) == phrases_brute(ROWS, least, longest, 50, top)


def test_a_bad_sample_costs_passes_only(docs):
    want = sorted(map(tuple, collocations.frequent_phrases(docs, 3, 3, 1)[0].collect()))
    whole, passes_whole = collocations.frequent_phrases(docs, 3, 3, 1)
    none, passes_none = collocations.frequent_phrases(docs, 3, 3, 10 ** 9)  # an empty sample
    assert passes_whole == 1 and passes_none == 3
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, none.collect())) == want


def test_full_bit_arrays_change_nothing(docs, monkeypatch):
    want = collocations.collocations(docs, 3).collect()
    monkeypatch.setattr(collocations, "empty_bits", lambda found, longest: [collocations.np.full(1 << 13, 255, "uint8") for _ in range(longest)])
    assert sorted(collocations.collocations(docs, 3).collect()) == sorted(want)


def test_small_chunks_count_the_same(docs, monkeypatch):
    texts = [(t or "").encode() for _, t, _ in ROWS]
    whole = {k: sum(n.sum() for _, n in collocations.Chunk([x], "en").counted(3, None, None)) for k, x in enumerate(texts) if x}
    assert sum(whole.values()) == sum(n.sum() for _, n in collocations.Chunk(texts, "en").counted(3, None, None))
    assert lowered_twice() == [2, 2, 53]


def lowered_twice():
    return [collocations.lowered(10, 8), collocations.lowered(10, 1), collocations.lowered(800, 8) - 17]


def test_rows_of_many_different_words_are_told_apart():
    np = collocations.np
    columns = [np.array([5, 1, 5, 1 << 39]), np.array([7, 2, 7, 1])]
    for bits in (20, 40):  # packed and sorted by columns
        cols = columns if bits == 40 else [c % (1 << 20) for c in columns]
        rows, n = collocations.distinct(cols, bits)
        assert dict(zip(zip(*(r.tolist() for r in rows)), n.tolist())) == collections.Counter(zip(*(c.tolist() for c in cols)))


def test_scores_are_exact_beyond_64_bits(spark):
    a, b, c = 3 * 10 ** 13 + 7, 4 * 10 ** 13 + 1, 5 * 10 ** 13 + 3
    counts = spark.createDataFrame([("x", 2, "p q", a), ("x", 1, "p", b), ("x", 1, "q", c), ("x", 0, "", c)], collocations.COUNTS)
    row = collocations.scored_phrases(counts).first()
    assert (row.l, row.r, row.score) == (b, c, 10 ** 6 * a * a // (b * c))


def test_ties_take_the_first_cut(spark):
    counts = spark.createDataFrame([("x", 3, "p q r", 10), ("x", 2, "p q", 20), ("x", 2, "q r", 10), ("x", 1, "p", 40), ("x", 1, "q", 50), ("x", 1, "r", 20)],
                                   collocations.COUNTS)
    row = collocations.scored_phrases(counts).where("phrase = 'p q r'").first()
    assert (row.l, row.r, row.score) == (40, 10, 250_000)


def test_collocations_of_nothing(empty, docs):
    assert collocations.collocations(empty).isEmpty()
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).isEmpty()
