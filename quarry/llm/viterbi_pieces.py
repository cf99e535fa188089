"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps the best path to each position of a window no longer than the
longest piece plus what has not yet been decided. Whenever the backpointer paths
of all positions that a piece can still start from meet in one boundary, the ids
up to it are committed and the window starts there. A border between two
characters that no piece holds side by side is such a boundary in every text, so
a text is cut there first, and the ids of each different stretch are remembered.

Scores are those of the vocabulary's pieces, added up; of equal sums the path
with the longer last piece wins, from the end backwards. A character that no
piece covers alone costs ten less than the lowest score and becomes its UTF-8
bytes' pieces (or the unknown id, if the vocabulary has none).

Defined results: a null or empty text has no ids; a blank is read as the
vocabulary's blank mark, and so decoding gives that mark's characters back as
blanks; every other text is decoded to itself. Repeated rows are encoded alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = "▁"
ROOM = 500_000

_MODELS: dict = {}


class Pieces:
    """The vocabulary of a SentencePiece model file."""

    def __init__(self, path: str | None = None, scores: dict | None = None, byte_ids: list | None = None, unknown: int = 0):
        """From a model file, or for tests from {piece: (id, score)}."""
        if path is not None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(sp.get_piece_size())
            plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
            scores = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
            unknown = sp.unk_id()
            byte_ids = [sp.piece_to_id(f"<0x{x:02X}>") for x in range(256)]
            byte_ids = byte_ids if all(map(sp.is_byte, byte_ids)) else None
        self.scores, self.byte_ids, self.unknown = scores, byte_ids, unknown
        self.longest = max(map(len, scores), default=1)
        self.floor = min((s for _, s in scores.values()), default=0.0) - 10
        self.inner = {p[k:k + 2] for p in scores for k in range(len(p) - 1)}
        # the ends of pieces' prefixes: where a search from one position may stop
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.ends = {p: scores[p][1] if p in scores else None for p in self.prefixes}
        self.texts = {i: p for p, (i, _) in scores.items()}
        self.known: dict[str, bytes] = {}  # ids as the bytes of 32-bit integers
        low = {i: chr(x) for x, i in enumerate(byte_ids[:128])} if byte_ids else {}
        self.plain_texts = self.texts | low

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.scores:
            return [self.scores[piece][0]]
        return [self.byte_ids[x] for x in piece.encode()] if self.byte_ids else [self.unknown]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the concatenated chunks, committed soon after they are settled.
        ``self.window`` is the longest window that was held."""
        text = ""               # the window's characters; position 0 is settled
        best, back = [0.0], [0]
        done = 0                # positions from which pieces were already started
        self.window = 0

        def commit(upto: int) -> list[int]:
            nonlocal text, best, back, done
            cuts, k = [upto], upto
            while k > 0:
                k = back[k]
                cuts.append(k)
            cuts.reverse()
            ids = [i for a, b in zip(cuts, cuts[1:]) for i in self.ids_of(text[a:b])]
            text, best, back, done = text[upto:], best[upto:], [max(0, x - upto) for x in back[upto:]], done - upto
            return ids

        def meeting() -> int:
            """The boundary that the paths of all open positions share."""
            front = set(range(done, len(best)))
            front = {p for p in front if best[p] is not None}
            while len(front) > 1:
                p = max(front)
                front.remove(p)
                front.add(back[p])
            return front.pop()

        def advance(last: bool) -> Iterator[list[int]]:
            nonlocal done
            n = len(text)
            # a position can be left only once all pieces that start there are in sight
            while done < n and (last or n - done >= self.longest):
                start, score = done, best[done]
                if score is not None:
                    if text[start] not in self.scores:
                        reach(start, start + 1, score + self.floor)
                    end = start + 1
                    while end <= n and text[start:end] in self.prefixes:
                        if (hit := self.scores.get(text[start:end])) is not None:
                            reach(start, end, score + hit[1])
                        end += 1
                done += 1
                self.window = max(self.window, len(best))
                if done >= 2 * self.longest and done % 8 == 0 and (at := meeting()) > 0:
                    yield commit(at)
                    n = len(text)

        def reach(start: int, end: int, score: float) -> None:
            while len(best) <= end:
                best.append(None)
                back.append(0)
            if best[end] is None or score > best[end]:
                best[end], back[end] = score, start

        for chunk in chunks:
            text += chunk
            yield from advance(False)
        yield from advance(True)
        if text:
            yield commit(len(text))

    def short(self, text: str) -> list[int]:
        """``stream`` for a text that its window holds whole, so that nothing is
        committed before the end: the same search without the bookkeeping."""
        n, ends, floor, never = len(text), self.ends, self.floor, self
        best: list = [0.0] + [None] * n
        back = [0] * (n + 1)
        for i in range(n):
            b = best[i]
            if b is None:
                continue
            if text[i] not in self.scores and (best[i + 1] is None or b + floor > best[i + 1]):
                best[i + 1], back[i + 1] = b + floor, i
            for j in range(i + 1, n + 1):
                score = ends.get(text[i:j], never)
                if score is never:
                    break
                if score is not None and (best[j] is None or b + score > best[j]):
                    best[j], back[j] = b + score, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.ids_of(text[a:b])]

    def stretches(self, text: str) -> list[str]:
        """``text`` cut at borders that no piece crosses, which need no search:
        before each run of marks, and around the line feeds that stand alone."""
        return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", text) if self.plain else [text]

    @property
    def plain(self) -> bool:
        if not hasattr(self, "_plain"):
            self._plain = not any(x[0] != MARK == x[1] or "\n" in x for x in self.inner)
        return self._plain

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = []
        for s in self.stretches(MARK + text.replace(" ", MARK)):
            ids = self.known.get(s)
            if ids is None:
                found = self.short(s) if len(s) <= 2 * self.longest else [i for part in self.stream([s]) for i in part]
                ids = np.array(found, np.int32).tobytes()
                if len(s) <= 64 and len(self.known) < ROOM:  # the first stretches met are the frequent ones
                    self.known[s] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.plain_texts.__getitem__, ids)).replace(MARK, " ")[1:]
        except KeyError:
            pass  # bytes of longer characters, or unknown ids
        out, raw = [], bytearray()
        of_byte = self._of_byte if hasattr(self, "_of_byte") else {i: x for x, i in enumerate(self.byte_ids or [])}
        self._of_byte = of_byte
        for i in ids:
            if i in of_byte:
                raw.append(of_byte[i])
                continue
            if raw:
                out.append(raw.decode())
                raw = bytearray()
            out.append(self.texts.get(i, "�"))
        out.append(raw.decode())
        return "".join(out).replace(MARK, " ")[1:]


def pieces(path: str) -> Pieces:
    """One model in each worker, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip), one row per row of ``docs``;
    round_trip: decoding the ids gives the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)

        def flush(first, ids, same):
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.record_batch([b.column(0).slice(first, len(ids)), pa.ListArray.from_arrays(offsets, values),
                                    pa.array(np.diff(offsets).astype(np.int64)), pa.array(same, pa.bool_())],
                                   ["doc_id", "ids", "n_tokens", "round_trip"])

        for b in batches:
            ids, same, size, first = [], [], 0, 0
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                ids.append(m.encode(text))
                same.append(m.decode(ids[-1].tolist()) == text.replace(MARK, " "))
                size += len(ids[-1])
                if size > 1 << 20:
                    yield flush(first, ids, same)
                    ids, same, size, first = [], [], 0, i + 1
            yield flush(first, ids, same)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_ids(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
