"""Problem 5: groups of near-duplicate texts by a blocked sparse product of texts and n-grams.

A text is the set of its word n-grams (64-bit hashes).  All n-grams have one total order, frequent
ones last; a text enters the incidence matrix with the shortest prefix of its n-grams in which any
text similar enough must meet it in ``MEET`` of them.  The matrix is multiplied with its transpose
block by block: each task holds the columns (n-grams) of its range and counts for pairs of texts how
many they share within the prefixes that follow from the sizes of both.  Counts are added up over
the blocks, and pairs that meet less often are discarded, others by bitmaps of the n-grams; what is
left is compared as whole sets, made from the texts again, so no n-grams are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm._graph import components, first_of_key
from passagework.runtime import is_empty, materialize, ship

WORD = re.compile(r"[^\W_]+")
#: Frequent n-grams that are kept in order of their counts; the table is broadcast, 16 bytes each.
FREQUENT = 1 << 19
#: N-grams of a part of the texts that are counted together where they are read.
COUNTED = 1 << 22
#: So many n-grams two texts must share within their prefixes; more lengthen the prefixes by as many.
MEET = 3
#: A column with more texts than this isn't multiplied out at once.
LONG = 128
#: Texts of a long column are compared in blocks of so many.
SIDE = 512
#: Words of 64 bits of a text's bitmap.
BITMAP = 8
ROWS = 2000


def _shingles(n: int):
    cache: dict[str, int] = {}

    def hashed(word: str) -> int:
        h = cache.get(word)
        if h is None:
            if len(cache) > 200_000:
                cache.clear()
            h = cache[word] = xxhash.xxh64_intdigest(word)
        return h

    def grams(text: str) -> np.ndarray | None:
        words = WORD.findall(text.lower())
        if len(words) < n:
            return None
        h = np.fromiter(map(hashed, words), np.uint64, len(words))
        g = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            g = (g ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
        return np.unique(g.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [grams(t) for t in batch.column(1).to_pylist()]
                keep = [i for i, g in enumerate(found) if g is not None]
                if keep:
                    lists = [found[i] for i in keep]
                    yield batch.column(0).take(pa.array(keep)), np.array([len(g) for g in lists], np.int64), np.concatenate(lists)

    return run


KEYS = "node long, k1 long, k2 long, size long, " + "".join(f"b{w} long, " for w in range(BITMAP)) + "gram long, n long"


def _keys(n: int):
    """A row for each text (keys of its set, size, bitmap), and rows (gram, n) of n-grams that a part of the texts has repeatedly."""
    names = [c.split()[0] for c in KEYS.split(", ")]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        g, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= 2
        rows = int(keep.sum())
        return pa.RecordBatch.from_arrays([*[pa.nulls(rows, pa.int64()) for _ in names[:-2]], pa.array(g[keep]), pa.array(n[keep])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for node, size, flat in _shingles(n)(batches):
            ends = np.cumsum(size)
            u = flat.view(np.uint64)
            keys = []
            for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                m = (u ^ u >> np.uint64(31)) * np.uint64(c)
                m ^= m >> np.uint64(27)
                s = np.concatenate([[0], np.cumsum(m, dtype=np.uint64)]).astype(np.uint64)
                keys.append((s[ends] - s[ends - size]).view(np.int64))
            bits = bitmaps(flat, size)
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([node, pa.array(keys[0]), pa.array(keys[1]), pa.array(size), *[pa.array(np.ascontiguousarray(bits[:, w])) for w in range(BITMAP)], none, none], names)
            held.append(flat)
            if sum(map(len, held)) >= COUNTED:
                yield counted(held)
                held.clear()
        if held:
            yield counted(held)

    return run


def _lists(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, size, flat in _shingles(n)(batches):
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))], ["node", "grams"])

    return run


def bitmaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bit for each n-gram of a text, ``BITMAP`` words a text.

    Every bit in which two bitmaps differ stands for at least one n-gram that only one text has.
    """
    u = flat.view(np.uint64)
    bit = (u >> np.uint64(20)) % np.uint64(64 * BITMAP)
    out = np.zeros(len(size) * BITMAP, np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(size)), size) * BITMAP + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64).reshape(-1, BITMAP)


def least_shared(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """So many n-grams texts of sizes ``x`` and ``y`` share if their similarity is ``t`` or more."""
    return np.maximum(1, np.ceil((x + y) * (t / (1 + t)) - 1e-9)).astype(np.int64)


def _weights(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, t: float) -> np.ndarray:
    """What a shared n-gram at places ``px`` and ``py`` of two texts counts for; 0 where it is beyond their prefixes.

    Without its last ``least_shared - m`` n-grams, a text shares ``m`` or more with any text similar
    enough, which may itself be cut likewise: of what they share, no more than those are beyond the
    prefix that ends first.  Weights add up to ``MEET`` there, also for texts that share fewer.
    """
    least = least_shared(x, y, t)
    m = np.minimum(MEET, least)
    inside = (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9) & (px < x - least + m) & (py < y - least + m)
    return np.where(inside, 1 + MEET - m, 0)


def _prefixes(n: int, frequent: np.ndarray, rank: np.ndarray, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, size, flat in _shingles(n)(batches):
            nodes = node.to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = np.zeros(len(flat), np.int64)
            if len(frequent):
                i = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                place = np.where(frequent[i] == flat, rank[i] + 1, 0)
            order = np.lexsort((flat, place, row))
            keep = size - np.ceil(t * size - 1e-9).astype(np.int64) + MEET
            start = np.cumsum(size) - size
            within = np.arange(len(flat)) - start[row]
            inside = within < keep[row]
            chosen = order[inside]
            r = row[chosen]
            # half of the hash names a column well enough; two n-grams in one column only add candidates
            yield pa.RecordBatch.from_arrays(
                [pa.array((flat[chosen] >> 32).astype(np.int32)), pa.array(nodes[r]), pa.array(size[r].astype(np.int32)), pa.array(within[inside].astype(np.int32))], ["gram", "node", "size", "at"]
            )

    return run


def _product(t: float, long: int):
    """One block of the product: rows come sorted by n-gram; gives (a, b, shared, star)."""

    def emit(a, b, n, star):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(star, pa.bool_())], ["a", "b", "shared", "star"])

    def multiply(gram, node, size, at):
        cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        length = np.diff(np.concatenate([cut, [len(gram)]]))
        a, b, w = [], [], []
        for n in np.unique(length[length > 1]):
            if n > long:
                continue
            columns = cut[length == n]
            i, j = np.triu_indices(int(n), 1)
            step = max(1, 1_000_000 // len(i))
            for k in range(0, len(columns), step):
                left, right = (columns[k : k + step, None] + i).ravel(), (columns[k : k + step, None] + j).ravel()
                weight = _weights(size[left], at[left], size[right], at[right], t)
                ok = np.flatnonzero(weight)
                u, v = node[left[ok]], node[right[ok]]
                a.append(np.minimum(u, v))
                b.append(np.maximum(u, v))
                w.append(weight[ok])
        if a:
            a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.array([], int)
            if len(first):
                yield emit(a[first], b[first], np.add.reduceat(w, first).astype(np.int32), np.zeros(len(first), bool))
        for s, n in zip(cut[length > long], length[length > long]):
            low = node[s : s + n].min()
            others = node[s : s + n][node[s : s + n] != low]
            yield emit(np.full(len(others), low), others, np.full(len(others), MEET, np.int32), np.ones(len(others), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("gram", "node", "size", "at")))
            rows += batch.num_rows
            if rows < 200_000:
                continue
            parts = [np.concatenate(x) for x in zip(*held)]
            last = np.searchsorted(parts[0], parts[0][-1])
            if last == 0:  # one long column only: its lowest text is met again by what follows
                yield from multiply(*parts)
                held, rows = [tuple(p[:1] for p in parts)], 1
                continue
            yield from multiply(*[p[:last] for p in parts])
            held, rows = [tuple(p[last:] for p in parts)], len(parts[0]) - last
        if rows:
            yield from multiply(*[np.concatenate(x) for x in zip(*held)])

    return run


def _similar(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            good = []
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= t * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _cross(t: float):
    """Pairs of texts from two blocks of one long column that are in different groups so far."""

    def run(key, table):
        node, size, at, root, block = (table.column(c).to_numpy() for c in ("node", "size", "at", "root", "block"))
        lo, hi = key[1].as_py(), key[2].as_py()
        left = np.flatnonzero(block == lo)
        right = np.flatnonzero(block == hi)
        a, b = [], []
        for i in left:
            ok = (root[right] != root[i]) & (node[right] != node[i]) & (_weights(size[i], at[i], size[right], at[right], t) > 0)
            a.append(np.minimum(node[i], node[right[ok]]))
            b.append(np.maximum(node[i], node[right[ok]]))
        a, b = (np.concatenate(v) if v else np.array([], np.int64) for v in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(passages: DataFrame, node: str = "ordinal", text: str = "text", n: int = 5, t: float = 0.8, long: int = LONG) -> DataFrame:
    """``node``, ``root`` of every text that is in a group of two or more; ``root`` is its lowest node.

    Linked are texts whose n-gram sets have a Jaccard similarity of at least ``t``; groups are what
    is linked directly or through others.  Rows with a null node or text and texts of fewer than
    ``n`` words take no part.  Equal sets of n-grams are compared once.  Rows repeated under one
    node count once; an empty table gives no rows.

    No column is cut off.  One with more than ``long`` texts first links them to its lowest text;
    after groups are formed from all links found so far, the pairs of such columns that are still in
    different groups are compared block against block.
    """
    spark = passages.sparkSession
    ship(spark)
    rows = passages.select(F.col(node).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where("node is not null and text is not null")
    keyed = materialize(rows.mapInArrow(_keys(n), KEYS), "keys")
    texts = keyed.where("gram is null").drop("gram", "n")
    equal = materialize(first_of_key(texts.select("node", "k1", "k2", "size"), ["k1", "k2", "size"], "node").where("node <> first").select("node", "first").distinct(), "equal")
    own = texts.drop("k1", "k2").join(equal.select("node"), "node", "left_anti")
    counts = keyed.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow().column("gram").to_numpy()  # at most FREQUENT rows
    rank = np.arange(len(frequent), 0, -1)
    order = np.argsort(frequent)
    whole = rows.join(equal.select("node"), "node", "left_anti")
    postings = whole.mapInArrow(_prefixes(n, frequent[order], rank[order], t), "gram int, node long, size int, at int")
    product = postings.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_product(t, long), "a long, b long, shared int, star boolean")
    pairs = product.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("star").alias("star"))
    met = materialize(pairs.where(F.col("shared") >= MEET).select("a", "b", "star"), "met")
    counted = materialize(_sized(met, own).where(_may_agree(t)).select("a", "b"), "candidates")
    links = _verified(counted, whole, n, t)
    links = materialize(links.union(equal.select(F.col("first").alias("a"), F.col("node").alias("b"))), "links")
    groups = components(links)
    # every column of more than ``long`` different texts gives pairs with its lowest one
    more = None if is_empty(met.where("star")) else _long_columns(postings, groups, t, long)
    if more is not None:
        more = materialize(_sized(more, own).where(_may_agree(t)).select("a", "b"), "more_candidates")
        extra = materialize(_verified(more, whole, n, t), "more_links")
        if not is_empty(extra):
            groups = components(links.union(extra))
    return groups


def _sized(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``pairs`` with the sizes (x, y) of both texts and in how many bits their bitmaps differ."""
    left = own.select(F.col("node").alias("a"), F.col("size").cast("int").alias("x"), *[F.col(f"b{w}").alias(f"l{w}") for w in range(BITMAP)])
    right = own.select(F.col("node").alias("b"), F.col("size").cast("int").alias("y"), *[F.col(f"b{w}").alias(f"r{w}") for w in range(BITMAP)])
    differ = sum((F.bit_count(F.col(f"l{w}").bitwiseXOR(F.col(f"r{w}"))) for w in range(1, BITMAP)), F.bit_count(F.col("l0").bitwiseXOR(F.col("r0"))))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, "x", "y", differ.alias("differ"))


def _may_agree(t: float):
    """Texts of similarity ``t`` differ in no more n-grams than this, so in no more bits."""
    return F.col("differ") <= (F.col("x") + F.col("y")) * ((1 - t) / (1 + t)) + 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: float) -> DataFrame:
    asked = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    own = materialize(texts.join(asked, "node", "left_semi").mapInArrow(_lists(n), "node long, grams array<long>"), "grams")
    x = own.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    y = own.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(t), "a long, b long")


def _long_columns(postings: DataFrame, groups: DataFrame, t: float, long: int) -> DataFrame | None:
    """Candidate pairs of columns with more than ``long`` texts that are not yet in one group."""
    columns = materialize(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long), "long")
    if is_empty(columns):
        return None
    members = postings.join(columns, "gram").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialize(members, "long_members")
    mixed = members.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("m")).where("low < high")
    mixed = mixed.select("gram", F.ceil(F.col("m") / SIDE).cast("int").alias("blocks"))
    split = members.join(mixed, "gram").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = spread.select("gram", "lo", "hi", "node", "size", "at", "root", "block").groupBy("gram", "lo", "hi").applyInArrow(_cross(t), "a long, b long")
    return materialize(found.distinct(), "cross")
