"""Problem 6: cutting long texts at natural boundaries, by ranges with halos.

Each text is read as ranges of ``RANGE`` code points with a halo of one before and ``HALO`` after.
A worker finds in its range where words begin and end and how natural a cut after each word is, and
hands back a boundary table.  The tables of one text are then read in order as
a stream that sums up the words and holds no more than one window of them; pieces come out as
offsets, by which the texts are cut in the end.  Texts of one range take a short cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.runtime import materialize, ship

RANGE = 1 << 16
HALO = 64
#: How natural a cut after a word is: end of paragraph, of line, of sentence, of clause, of word.
PARAGRAPH, LINE, SENTENCE, CLAUSE, PLAIN = 4, 3, 2, 1, 0
SENTENCE_ENDS = ".!?…。！？;"
CLAUSE_ENDS = ",:，、）)]；"
CLOSING = "\"'”’»)]）」"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """1 white space, 2 line break, 4 sentence end, 8 clause end, 16 closing mark, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x3100):
        if chr(c).isspace():
            out[c] = 1
    for chars, bit in (("\n\r\x0b\x0c\x85\u2028\u2029", 2), (SENTENCE_ENDS, 4), (CLAUSE_ENDS, 8), (CLOSING, 16)):
        for c in chars:
            out[ord(c)] |= bit
    return out


def boundaries(text: str, before: str, after: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, strengths) of a range: ends are exclusive and belong to words that end in the range.

    ``before`` and ``after`` are the halo; a word is counted in the range where it begins, its end
    where it ends.
    """
    whole = before + text + after
    kind = classes()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = (kind & 1) > 0
    n, lead = len(text), len(before)
    prev = np.concatenate([[True], space[:-1]])
    nxt = np.concatenate([space[1:], [True]]) if len(space) else space
    starts = np.flatnonzero(~space & prev)
    ends = np.flatnonzero(~space & nxt)
    starts = starts[(starts >= lead) & (starts < lead + n)]
    if after and len(whole) and not space[-1]:
        ends = ends[ends < len(whole) - 1]
    ends = ends[(ends >= lead) & (ends < lead + n)]
    strength = np.zeros(len(ends), np.int8)
    last = ends.copy()
    for _ in range(3):  # closing marks may follow the mark that ends a sentence
        back = ((kind[last] & 16) > 0) & (last > 0) & ~space[np.maximum(last - 1, 0)]
        strength = np.maximum(strength, np.where((kind[last] & 4) > 0, SENTENCE, np.where((kind[last] & 8) > 0, CLAUSE, PLAIN)))
        last = np.where(back, last - 1, last)
    strength = np.maximum(strength, np.where((kind[last] & 4) > 0, SENTENCE, PLAIN))
    breaks = np.concatenate([[0], np.cumsum((kind & 2) > 0)])
    following = np.searchsorted(np.flatnonzero(~space), ends, side="right")
    solid = np.append(np.flatnonzero(~space), len(whole))
    lines = breaks[solid[following]] - breaks[ends + 1]
    crlf = np.concatenate([[0], np.cumsum((np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32) == 13)[:-1] & (np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)[1:]), [0]]).astype(np.int64)
    if len(crlf) > 1:
        crlf[-1] = crlf[-2]
        lines = lines - (crlf[np.minimum(solid[following], len(crlf) - 1)] - crlf[np.minimum(ends + 1, len(crlf) - 1)])
    strength = np.maximum(strength, np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, LINE, PLAIN)))
    return starts - lead, ends + 1 - lead, strength


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [boundaries(t, b, a) for t, b, a in zip(*(batch.column(c).to_pylist() for c in ("core", "before", "after")))]
        base = batch.column("at").to_numpy()

        def lists(k, kind):
            parts = [o[k] + (base[i] if k < 2 else 0) for i, o in enumerate(out)]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(kind) if parts else np.array([], kind)))

        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("range"), lists(0, np.int64), lists(1, np.int64), lists(2, np.int8)], ["node", "range", "starts", "ends", "strengths"])


class Cutter:
    """Cuts the words of one text as they come; holds one window of words at most."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.strengths: list[int] = []
        self.first = 0
        self.piece = 0

    def add(self, starts, ends, strengths) -> Iterator[tuple[int, ...]]:
        self.starts += starts
        self.ends += ends
        self.strengths += strengths
        while min(len(self.starts), len(self.ends)) > self.size:
            yield self._cut(self._best())

    def close(self) -> Iterator[tuple[int, ...]]:
        if self.ends:
            yield self._cut(min(len(self.starts), len(self.ends)))

    def _best(self) -> int:
        """Number of words of the next piece: up to the most natural and last boundary in its last half."""
        least = max(self.size // 2, self.overlap + 1)
        window = self.strengths[least - 1 : self.size]
        top = max(window)
        if top == PLAIN:
            return self.size
        return self.size - window[::-1].index(top)

    def _cut(self, n: int) -> tuple[int, ...]:
        out = (self.piece, self.starts[0], self.ends[n - 1], self.first, n)
        self.piece += 1
        back = n - self.overlap if n > self.overlap else n
        self.first += back
        del self.starts[:back], self.ends[:back], self.strengths[:back]
        return out


def _pieces(size: int, overlap: int):
    """Boundary tables of one text after the other, ranges in order, to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, last, cutter, out = None, None, None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("node", "range", "starts", "ends", "strengths")]
            for who, number, starts, ends, strengths in zip(*cols):
                if who != node:
                    if cutter is not None:
                        out += [(node, *p) for p in cutter.close()]
                    node, last, cutter = who, None, Cutter(size, overlap)
                if number == last:  # the same row delivered twice
                    continue
                last = number
                out += [(node, *p) for p in cutter.add(starts, ends, strengths)]
            if out:
                yield _rows(out)
                out = []
        if cutter is not None:
            out += [(node, *p) for p in cutter.close()]
        if out:
            yield _rows(out)

    return run


def _short(size: int, overlap: int):
    """Texts of one range, cut where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, ends, strengths = (v.tolist() for v in boundaries(text, "", ""))
                cutter = Cutter(size, overlap)
                out += [(who, *p) for p in cutter.add(starts, ends, strengths)]
                out += [(who, *p) for p in cutter.close()]
            if out:
                yield _rows(out)

    return run


PIECE = "node long, piece long, start long, end long, first_word long, words long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [f.split()[0] for f in PIECE.split(", ")])


def piece_offsets(texts: DataFrame, node: str = "ordinal", text: str = "text", size: int = 256, overlap: int = 32, span: int = RANGE) -> DataFrame:
    """``node, piece, start, end, first_word, words`` of every piece; offsets are code points, ends exclusive.

    Texts of up to ``size`` words are one piece from the first to the last word; null nodes and
    texts, and texts without a word, give none.  A text of one range is cut where it is read; longer
    ones are spread as ranges and stitched.  Rows repeated under one node must be equal and count once. A
    piece ends at the most natural boundary in its second half, the last one among equals, and the
    next begins ``overlap`` words before that end.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be at least 0 and less than half of size")
    ship(texts.sparkSession)
    rows = texts.select(F.col(node).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where("node is not null and text is not null")
    short = rows.where(F.char_length("text") <= span).mapInArrow(_short(size, overlap), PIECE)
    long = rows.where(F.char_length("text") > span)
    ranges = long.withColumn("range", F.explode(F.sequence(F.lit(0), ((F.char_length("text") - 1) / span).cast("int"))))
    at = F.col("range") * span
    ranges = ranges.select(
        "node", F.col("range").cast("long").alias("range"), at.cast("long").alias("at"), F.substring("text", at + 1, F.lit(span)).alias("core"),
        F.when(at > 0, F.substring("text", at, F.lit(1))).otherwise("").alias("before"), F.substring("text", at + span + 1, F.lit(HALO)).alias("after"),
    )
    tables = ranges.repartition("node", "range").mapInArrow(_tables, "node long, range long, starts array<long>, ends array<long>, strengths array<byte>")
    stitched = tables.repartition("node").sortWithinPartitions("node", "range").mapInArrow(_pieces(size, overlap), PIECE)
    return short.union(stitched)


def text_pieces(texts: DataFrame, node: str = "ordinal", source: str = "id", text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """``source_id, piece, first_word, words, text`` of the pieces of every text over ``size`` words."""
    offsets = piece_offsets(texts, node, text, size, overlap)
    cut = Window.partitionBy("node")
    offsets = offsets.withColumn("pieces", F.max("piece").over(cut)).where("pieces > 0").dropDuplicates(["node", "piece"])
    rows = texts.select(F.col(node).cast("long").alias("node"), F.col(source).alias("source_id"), F.col(text).cast("string").alias("text")).where("node is not null and text is not null").dropDuplicates(["node"])
    body = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return offsets.join(rows, "node").select("source_id", "piece", "first_word", "words", body.alias("text"))


def oversized(texts: DataFrame, node: str = "ordinal", source: str = "id", text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """``source_id`` of each text that had to be cut."""
    cut = piece_offsets(texts, node, text, size, overlap).where("piece = 1").select("node").distinct()
    return texts.select(F.col(node).cast("long").alias("node"), F.col(source).alias("source_id")).join(cut, "node").select("source_id").distinct()
