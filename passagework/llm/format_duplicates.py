"""Problem 1: records that differ only in white space, case, punctuation or order of fields.

Texts are streamed in blocks of code points through a table that skips what is no letter or digit
and folds the rest, straight into two rolling polynomial hashes; a canonical string is never
built.  Rows with equal hashes are then compared with their group's first row by two pointers that
skip in the same manner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm._graph import first_of_key
from passagework.runtime import is_empty, materialize, ship

BLOCK = 1 << 19
PRIMES = (2147483647, 2147483629)
PART = re.compile(r"[;|\n\r\x0b\x0c\x85\u2028\u2029]")
SEPARATOR = re.compile(r"[:=]")


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point the number of folded codes (0 skips it) and up to three codes."""
    count = np.zeros(0x110000, np.uint8)
    codes = np.zeros((0x110000, 3), np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            kept = [ord(x) for x in s.casefold() if x.isalnum()][:3] or [c]
            count[c] = len(kept)
            codes[c, : len(kept)] = kept
    return count, codes


@lru_cache(maxsize=16)
def powers(seed: int, which: int) -> np.ndarray:
    p = PRIMES[which]
    base = (0x9E3779B1 + 0x85EBCA77 * (2 * seed + which + 1)) % (p - 3) + 2
    out = np.ones(3 * BLOCK, np.uint64)
    n = 1
    while n < len(out):
        m = min(n, len(out) - n)
        step = int(out[n - 1]) * base % p
        out[n : n + m] = out[:m] * np.uint64(step) % np.uint64(p)
        n += m
    return out


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes of ``text`` and how many came from each of its code points."""
    count, table = fold_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = count[points]
    if n.max(initial=0) <= 1:
        return table[points[n > 0], 0], n
    at = np.repeat(np.arange(len(points)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
    return table[points[at], within], n


def hash_texts(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash as uint64, number of kept codes) of each text."""
    out, size = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        if len(texts[i]) > BLOCK:
            out[i], size[i] = _hash_long(texts[i], seed)
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and total + len(texts[j]) <= BLOCK:
            total += len(texts[j])
            j += 1
        codes, n = _codes("".join(texts[i:j]))
        ends = np.cumsum(np.array([len(t) for t in texts[i:j]], np.int64))
        kept = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        stop = kept[ends]
        start = np.concatenate([[0], stop[:-1]])
        size[i:j] = stop - start
        place = np.arange(len(codes)) - np.repeat(start, stop - start)
        value = np.zeros(j - i, np.uint64)
        for which, p in enumerate(PRIMES):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers(seed, which)[place] % np.uint64(p)
            sums = np.concatenate([[0], np.cumsum(terms, dtype=np.uint64)]).astype(np.uint64)
            value = value << np.uint64(31) ^ (sums[stop] - sums[start]) % np.uint64(p)
        out[i:j] = value
        i = j
    return out, size


def _hash_long(text: str, seed: int) -> tuple[int, int]:
    sums, place = [0, 0], 0
    for at in range(0, len(text), BLOCK):
        codes, _ = _codes(text[at : at + BLOCK])
        for which, p in enumerate(PRIMES):
            table = powers(seed, which)
            base = int(table[1])
            terms = (codes.astype(np.uint64) + np.uint64(1)) * table[: len(codes)] % np.uint64(p)
            sums[which] = (sums[which] + int(terms.sum(dtype=np.uint64)) % p * pow(base, place, p)) % p
        place += len(codes)
    return sums[0] << 31 ^ sums[1], place


def record_parts(text: str) -> list[str] | None:
    """The non-blank parts of a field record, else None."""
    if ":" not in text and "=" not in text:
        return None
    parts = [p for p in PART.split(text) if p.strip()]
    if len(parts) < 3:
        return None
    for p in parts:
        m = SEPARATOR.search(p)
        if not m or not p[: m.start()].strip() or not p[m.end() :].strip():
            return None
    return parts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hash_passages(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kept codes, is a field record).  The order of a record's parts does not matter."""
    records = [(i, p) for i, t in enumerate(texts) if (p := record_parts(t))]
    is_record = np.zeros(len(texts), bool)
    flat = list(texts)
    for i, _ in records:
        is_record[i], flat[i] = True, ""
    value, size = hash_texts(flat, seed)
    if records:
        h, n = hash_texts([p for _, parts in records for p in parts], seed)
        owner = np.repeat([i for i, _ in records], [len(p) for _, p in records])
        mixed = np.where(n > 0, _mix(h + np.uint64(1) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
        np.add.at(value, owner, mixed)
        np.add.at(size, owner, n)
    return value, size, is_record


def _same_stream(a: str, b: str) -> bool:
    """Two pointers that skip what is no letter or digit, moved on block by block."""
    i = j = 0
    x = y = np.zeros(0, np.uint32)
    while True:
        while not len(x) and i < len(a):
            x, _ = _codes(a[i : i + BLOCK])
            i += BLOCK
        while not len(y) and j < len(b):
            y, _ = _codes(b[j : j + BLOCK])
            j += BLOCK
        m = min(len(x), len(y))
        if m == 0:
            return len(x) == len(y)
        if not np.array_equal(x[:m], y[:m]):
            return False
        x, y = x[m:], y[m:]


def same_passage(a: str, b: str) -> bool:
    """Whether two texts are copies, compared without hashes."""
    p, q = record_parts(a), record_parts(b)
    if (p is None) != (q is None):
        return False
    if p is None:
        return _same_stream(a, b)
    left = [y for y in q if len(_codes(y)[0])]
    for x in p:
        if not len(_codes(x)[0]):
            continue
        k = next((k for k, y in enumerate(left) if _same_stream(x, y)), None)
        if k is None:
            return False
        del left[k]
    return not left


def _keys(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, size, record = hash_passages(batch.column(1).to_pylist(), seed)
            keep = np.flatnonzero(size > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(value[keep].view(np.int64)), pa.array(size[keep] * 2 + record[keep])], ["node", "hash", "size"]
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [same_passage(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("first_text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("node"), pa.array(same, pa.bool_())], ["first", "node", "same"])


def format_duplicates(passages: DataFrame, node: str = "ordinal", text: str = "text", chunk: int = 2048) -> DataFrame:
    """``first`` and ``node`` of each row that is a copy of a row with a lower ``node``.

    Rows with a null node or text, and texts without letter or digit, take no part.  Rows repeated
    under one node count once.  Extra columns are ignored; an empty table gives no rows.  The first
    text of a large set is handed out once per ``chunk`` rows, so that no task holds a whole set.
    """
    spark = passages.sparkSession
    ship(spark)
    rows = passages.select(F.col(node).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where("node is not null and text is not null")
    found, left, seed = [], None, 0
    while True:
        todo = rows if left is None else rows.join(left, "node", "left_semi")
        keys = todo.mapInArrow(_keys(seed), "node long, hash long, size long")
        pairs = materialize(first_of_key(keys, ["hash", "size"], "node").where("node <> first").select("first", "node", "copies").distinct(), "pairs")
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("copies") / chunk)).cast("long")
        member = pairs.withColumn("salt", salt).join(rows, "node")
        heads = pairs.groupBy("first").agg(F.max("copies").alias("copies")).select("first", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("copies") / chunk) - 1).cast("long"))).alias("salt"))
        heads = heads.join(rows.select(F.col("node").alias("first"), F.col("text").alias("first_text")), "first")
        checked = member.join(heads, ["first", "salt"]).select("first", "node", "text", "first_text")
        checked = materialize(checked.mapInArrow(_verify, "first long, node long, same boolean"), "checked")
        found.append(checked.where("same").select("first", "node"))
        left = checked.where("not same").select("node")
        seed += 1
        if is_empty(left):
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def copy_counts(passages: DataFrame, node: str = "ordinal", text: str = "text") -> DataFrame:
    """One row per set of copies: its lowest node and the number of its rows (2 or more)."""
    return format_duplicates(passages, node, text).groupBy("first").agg((F.count(F.lit(1)) + 1).alias("copies"))
