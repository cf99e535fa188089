"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. It is
called on successive prefixes of a conversation, and consecutive outputs are
compared: what comes after their common beginning is the new turn's span, and
characters of the earlier output that are gone mean that the template rewrites
history. Where the text lies within a span is found by rendering the same prefix
once more with a mark in place of the last text. So nothing of the template is
known but its outputs; ``inst_template`` is the one that the query uses.

Prefixes would grow with the square of a conversation, so they start anew every
``BLOCK`` turns: after the conversation's first ``HEAD`` turns and the ``HALO``
turns before the block. What a template does with turns further back is checked,
not assumed: the later half of the halo is rendered in both blocks, and all turns
of a conversation of several blocks are rendered once more in one call, which must
equal what the blocks make up at every position. Where these differ, or a block's
template takes back what lies before its halo, the conversation is rendered once
more over whole prefixes. Only a template that looks far back pays for that; a
conversation's length alone never does.

A task streams sorted turns and holds one segment and its context. Conversations
of over ``SEGMENT`` turns (counted first, by aggregation) are cut into segments
that are dealt to different tasks with copies of their context; their borders
are checked by digests of the overlapping spans, and the one call is made twice: over
each segment and its context, and over all turns, which must equal what the blocks of
all segments make up. A template is given a list, so a task holds a conversation's
text for this call; it reads a row a segment.

The output is one row a block: the text, and for each turn its span, its loss
span (assistant texts only, else empty) and the characters that it takes back
from what was rendered before. ``output[:-takes_back] + span`` for every turn in
order gives the last rendering, for a template that rewrites history as well;
such rows are marked ``rewrites``, because no single mask fits all turns then.

Defined results: a null text or role is empty, a null conversation is one of its
own; turns that tie are ordered by role and text, nulls first, and repeated rows
are turns of their own. An empty table gives no rows. Texts of any length are
kept whole. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage

Turn = tuple[str, str]
Template = Callable[[list], str]

BLOCK, HALO, HEAD, SEGMENT = 64, 16, 2, 4096  # turns

#: What the template writes around texts. In a text, a run of backslashes (or
#: none) after the opening bracket of such a string is one longer.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?TURN(?::[\w.~%-]*)?\])"
_ESCAPE, _UNESCAPE = re.compile(CONTROL, re.ASCII), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"), re.ASCII)
_AROUND = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def inst_template(turns: list[Turn]) -> str:
    """``<s>``, then each turn between its role's marks; a role that has none is
    named. The texts cannot hold a mark, as control strings are escaped."""
    out = ["<s>"] if turns else []
    for role, text in turns:
        before, after = _AROUND.get(role) or (f"[TURN:{quote(role, safe='')}] ", " [/TURN]")
        out += [before, escape(text), after]
    return "".join(out)


def read_inst(text: str) -> Iterator[Turn]:
    """The turns of formatted text (``inst_template`` backwards)."""
    at = len("<s>") if text.startswith("<s>") else 0
    while at < len(text):
        role = next((r for r, (before, _) in _AROUND.items() if text.startswith(before, at)), None)
        if role is None and not text.startswith("[TURN:", at):
            raise ValueError("not written by inst_template")
        if role is None:
            start = text.index("] ", at) + 2
            role, after = unquote(text[at + len("[TURN:"):start - 2]), " [/TURN]"
        else:
            start, after = at + len(_AROUND[role][0]), _AROUND[role][1]
        end = text.index(after, start)
        yield role, unescape(text[start:end])
        at = end + len(after)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] is common, a[:high + 1] is not
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_span(template: Template, before: list[Turn], turn: Turn, out: str) -> tuple[int, int]:
    """Where the turn's text lies in ``out``, the rendering of ``before`` and the
    turn: the same rendering with a mark as its text, which no output has yet,
    shows what the template writes before and after it."""
    mark = "\uE000\uE001"
    while mark in out:
        mark = mark[:-1] + "\uE002\uE001"
    probe = template([*before, (turn[0], mark)])
    lead, found, tail = probe.partition(mark)
    if not found or not out.startswith(lead) or not out.endswith(tail) or len(lead) + len(tail) > len(out):
        raise ValueError("the template does not write the last turn's text in one place")
    return len(lead), len(out) - len(tail)


def render_turns(template: Template, context: list[Turn], turns: list[Turn]) -> Iterator[tuple]:
    """(span, loss start, loss end, characters taken back) of each of ``turns``
    after ``context``; loss positions count from the span's start."""
    prefix = list(context)
    out = template(prefix) if prefix else ""
    for turn in turns:
        longer = template([*prefix, turn])
        same = common(out, longer)
        first, last = text_span(template, prefix, turn, longer) if turn[0] == "assistant" else (same, same)
        yield longer[same:], max(first, same) - same, max(last, same) - same, len(out) - same
        prefix.append(turn)
        out = longer


def spans_digest(spans: list[tuple]) -> bytes:
    h = hashlib.sha256()
    for span, *at in spans:
        h.update(f"{len(span)} {at}\n{span}".encode())
    return h.digest()


_PLACE = ("start", "end", "loss_start", "loss_end", "takes_back", "turn")
FORMATTED = (f"conv_id long, block long, text string, turns array<struct<{','.join(f'{c}:long' for c in _PLACE)}>>, "
             "rewrites boolean, far_history boolean, edge binary, overlap binary")
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in _PLACE])), pa.bool_(), pa.bool_(),
          pa.binary(), pa.binary()]
_FLUSH = 1 << 22  # characters in a batch of output


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], [c.split()[0] for c in FORMATTED.split(", ")])


class Segment:
    """Renders the turns of one segment, block by block; the context of a later
    segment comes first (own = False)."""

    def __init__(self, template: Template, conv: int | None, block: int | None):
        self.template, self.conv, self.block = template, conv, block
        self.head: list[Turn] = []
        self.near: deque = deque(maxlen=HALO + 1)
        self.overlap: bytes | None = None
        self.blocks, self.parts = 0, []

    def keep(self, turn: Turn) -> None:
        (self.head if len(self.head) < HEAD else self.near).append(turn)

    def rows(self, turns: Iterator[tuple]) -> Iterator[tuple]:
        own, said, last, context, seen = [], [], None, [], False
        for at, mine, role, text in turns:
            if not mine:
                self.keep((role, text))
                continue
            if not seen:
                context = self.context(at)
                said, seen = list(context), True
            own.append((at, (role, text)))
            if self.block:
                said.append((role, text))
            if len(own) == self.block:
                if last:
                    yield last
                last, own = self.shown(own[0][0], [t for _, t in own], context), []
        if own:
            if last:
                yield last
            last = self.shown(own[0][0], [t for _, t in own], context)
        if last:
            yield last if self.blocks < 2 or self.whole_matches(said) else (*last[:5], True, *last[6:])

    def shown(self, start: int, own: list[Turn], context: list[Turn]) -> tuple:
        """A block's row; what it renders is kept for ``whole_matches``."""
        if self.block and not self.blocks:
            self.parts = [self.template(context) if context else ""]
        row = self.row(start, own)
        self.blocks += 1
        if self.block and not row[4]:
            self.parts.append(row[2])
        elif self.block:
            for p in row[3]:
                out = "".join(self.parts)
                self.parts = [out[:max(0, len(out) - p["takes_back"])], row[2][p["start"]:p["end"]]]
        return row

    def whole_matches(self, said: list[Turn]) -> bool:
        """Whether the blocks make up what the template writes of all the
        segment's turns at once: this looks at every position. For conversations of
        several segments ``unmatched`` does so over all turns."""
        return "".join(self.parts) == self.template(said)

    def context(self, start: int) -> list[Turn]:
        """What goes before turn ``start``; an even number of turns is skipped, as templates may go by parity."""
        return [*self.head, *list(self.near)[-(HALO + start % 2):]] if start else []

    def row(self, start: int, own: list[Turn]) -> tuple:
        context, again = [], 0
        if start:
            context, again = self.context(start), HALO // 2
        known, early = context[:len(context) - again], context[len(context) - again:]
        spans = list(render_turns(self.template, known, early + own))
        floor = length = len(self.template(known)) if known else 0
        far = False
        for span, _, _, back in spans:
            far |= length - back < floor
            length += len(span) - back
        edge, spans = spans_digest(spans[:again]), spans[again:]
        far |= self.overlap not in (None, edge)
        self.overlap = spans_digest(spans[-(HALO // 2):])
        places, upto = [], 0
        for k, (span, first, last, back) in enumerate(spans):
            places.append(dict(zip(_PLACE, (upto, upto + len(span), upto + first, upto + last, back, start + k))))
            upto += len(span)
        for turn in own:
            self.keep(turn)
        return (self.conv, start // BLOCK, "".join(s[0] for s in spans), places, any(s[3] for s in spans), far, edge, self.overlap)


def rendered(turns: DataFrame, template: Template, block: int | None = BLOCK) -> DataFrame:
    """``FORMATTED`` rows of (conv_id, segment, at, own, role, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out, size, last, place = [], 0, object(), 0

        def placed():
            """``at`` of turns that were not numbered is their place in the stream."""
            nonlocal last, place
            for conv, segment, at, mine, role, text in rows:
                place = place + 1 if conv == last else 0
                last = conv
                yield conv, segment, place if at is None else at, mine, role, text

        for (conv, _), some in groupby(placed(), key=lambda r: r[:2]):
            for row in Segment(template, conv, block).rows(r[2:] for r in some):
                out.append(row)
                size += len(row[2])
                if size > _FLUSH or len(out) == 4096:
                    yield as_batch(out)
                    out, size = [], 0
        if out:
            yield as_batch(out)

    dealt = turns.repartition("conv_id", "segment").sortWithinPartitions(
        "conv_id", "segment", "own", "at", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "segment", "at", "own", "role", "text").mapInArrow(run, FORMATTED)


def plain_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def numbered(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``at``, a turn's place in its conversation, from 0: counted
    within ranges of ``width`` turn numbers, to which the counts of the ranges
    before are added."""
    rows = rows.withColumn("range", F.floor(F.col("turn") / width))
    upto = Window.partitionBy("conv_id").orderBy(F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "before")
    place = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("place", F.row_number().over(place) - 1).join(
        before, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("range").eqNullSafe(F.col("_r"))).select(
        "conv_id", "turn", "role", "text", (F.col("place") + F.col("before")).cast("long").alias("at"))


def segmented(rows: DataFrame, segment: int) -> DataFrame:
    """Turns of long conversations with their segment, and copies of the turns
    that later segments need as context."""
    turns = stage(numbered(rows, segment), "chat-long")
    of = F.floor(F.col("at") / segment).cast("long")
    last = turns.groupBy("conv_id").agg(F.max(of).alias("last")).select(F.col("conv_id").alias("_c"), "last")
    columns = ["conv_id", "turn", "role", "text", "at"]
    context = turns.where((F.col("at") < HEAD) | (F.pmod("at", F.lit(segment)) >= segment - HALO)).join(
        last, F.col("conv_id").eqNullSafe(F.col("_c"))).select(*columns, F.explode(
            F.when(F.col("at") < HEAD, F.sequence(F.lit(0).cast("long"), F.col("last"))).otherwise(F.array(of + 1))).alias("segment"), "last")
    context = context.where("segment between 1 and last").select(*columns, "segment", F.lit(False).alias("own"))
    return turns.select(*columns, of.alias("segment"), F.lit(True).alias("own")).unionByName(context)


def made_up(blocks: list[tuple]) -> str:
    """What blocks (text, places) make up in order."""
    parts: list[str] = []
    for text, places in blocks:
        for p in places:
            back = p["takes_back"]
            while back and parts:
                last = parts.pop()
                if len(last) > back:
                    parts.append(last[:len(last) - back])
                back = max(0, back - len(last))
            parts.append(text[p["start"]:p["end"]])
    return "".join(parts)


def unmatched(turns: DataFrame, blocks: DataFrame, template: Template, segment: int) -> DataFrame:
    """(conv_id) of the conversations whose blocks do not make up what the
    template writes of all their turns (conv_id, segment, at, role, text) at once."""
    places = blocks.schema["turns"].dataType.simpleString()
    packed = f"array<struct<at:long,role:string,text:string,turns:{places}>>"
    none = F.lit(None)
    said = turns.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct(
        "at", "role", "text", none.cast(places).alias("turns")))).cast(packed).alias("rows"))
    shown = blocks.groupBy("conv_id", F.floor(F.col("block") * BLOCK / segment).cast("long").alias("segment")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("block").alias("at"), none.cast("string").alias("role"), "text", "turns"))).cast(packed).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for conv, some in groupby(rows, key=lambda r: r[0]):
            all_turns, all_blocks = [], []
            for _, is_block, of_segment in some:
                if is_block:
                    all_blocks += [(r["text"], r["turns"]) for r in of_segment]
                else:
                    all_turns += [(r["role"], r["text"]) for r in of_segment]
            if made_up(all_blocks) != template(all_turns):
                yield pa.record_batch([pa.array([conv], pa.int64())], ["conv_id"])

    dealt = said.withColumn("is_block", F.lit(False)).unionByName(shown.withColumn("is_block", F.lit(True))).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "is_block", "segment").select("conv_id", "is_block", "rows").mapInArrow(run, "conv_id long")


def of_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return rows.join(ids.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), how)


def format_conversations(conversations: DataFrame, path: str, template: Template = inst_template, segment: int = SEGMENT) -> str:
    """Write the formatted blocks as Parquet below ``path`` (module docstring);
    ``segment``: an even number of blocks' turns."""
    spark = conversations.sparkSession
    turns = plain_turns(conversations)
    long = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select("conv_id"), "chat-ids")
    any_long = not long.isEmpty()

    def one_segment(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("segment"), F.lit(True).alias("own"))

    rows = one_segment(of_ids(turns, long, "left_anti") if any_long else turns)
    if any_long:
        dealt = segmented(of_ids(turns, long, "left_semi"), segment)
        rows = rows.unionByName(dealt)
    rendered(rows, template).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(FORMATTED).parquet(f"{path}/blocks")
    far = blocks.where("far_history").select("conv_id")
    if any_long:
        border = F.col("block") % (segment // BLOCK) == 0
        edges = blocks.where(border & (F.col("block") > 0)).select("conv_id", "block", F.col("edge").alias("digest")).unionByName(
            blocks.withColumn("block", F.col("block") + 1).where(border).select("conv_id", "block", F.col("overlap").alias("digest")))
        far = far.unionByName(edges.groupBy("conv_id", "block").agg(
            F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("differ")).where("n = 2 and differ").select("conv_id"))
        far = far.unionByName(unmatched(dealt.where("own"), of_ids(blocks, long, "left_semi"), template, segment))
    far = stage(far.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id"), "chat-far")
    whole = spark.createDataFrame([], FORMATTED) if far.isEmpty() else rendered(
        one_segment(of_ids(turns, far, "left_semi")), template, None).withColumn("far_history", F.lit(True))
    whole.write.parquet(f"{path}/whole")
    return path


def formatted_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The written rows: whole renderings stand for the blocks of their conversation."""
    blocks, whole = (spark.read.schema(FORMATTED).parquet(f"{path}/{name}") for name in ("blocks", "whole"))
    if whole.isEmpty():
        return blocks
    return of_ids(blocks, whole.select("conv_id").distinct(), "left_anti").unionByName(whole)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "rewrites boolean, far_history boolean")


def conversation_digests(blocks: DataFrame, read: Callable[[str], Iterator[Turn]] | None = read_inst,
                         plain: Callable[[str], str] = unescape) -> DataFrame:
    """One row a conversation, read back from formatted text alone: its turns as
    ``read`` finds them (None: their digest is null), and the text under the loss
    mask, unescaped by ``plain``. Where a template rewrites history no single text
    holds all turns: the digests are null. A digest goes through a conversation in order, a block at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, some in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, chars, size, rewrites, far = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False, False
            for _, _, text, places, back, seen_far in some:
                rewrites |= back
                far |= seen_far
                size += len(text) - sum(p["takes_back"] for p in places)
                if rewrites:
                    n += len(places)
                    continue
                for role, said in read(text) if read else ():
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                n += 0 if read else len(places)
                for p in places:
                    under = plain(text[p["loss_start"]:p["loss_end"]])
                    loss.update(under.encode())
                    chars += len(under)
            digests = (None, None, None) if rewrites else (turns.hexdigest() if read else None, chars, loss.hexdigest())
            out.append((conv, n, *digests, size, rewrites, far))
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")])
    dealt = blocks.select("conv_id", "block", "text", "turns", "rewrites", "far_history").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "block").mapInArrow(run, READ)
