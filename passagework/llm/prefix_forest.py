"""Problem 3: the most similar vectors of every vector, by a forest of long hash strings.

Each of ``TREES`` trees gives a vector a long string of hash digits; a digit is the strongest axis
of one random rotation, and every tree begins with another rotation.  A vector descends to the
shortest prefix whose run of the sorted strings holds at most ``RUN`` vectors, so prefixes are long
where vectors are dense; small runs are put together with their neighbours below the same parent.
All trees ascend together up to the first digit, however many vectors there are: what lies below it
is compared part against part, so a crowded run loses nothing by having been cut.  Two parts are
compared at once as a matrix product of 16-bit vectors.  What is too close to call is decided from the original embeddings in
double: pair by pair, or within the block where more than ``TIES`` of it are too close for one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import _codes
from passagework.llm._graph import first_of_key
from passagework.runtime import is_empty, materialize, ship

TREES = 6
AXES = 128
RUN = 8192
K = 5
MIN_COSINE = 0.8
#: Cosines from 16-bit vectors are off by less than this.
SLACK = 2e-5
#: Candidates of a vector in a block beyond which its ``k`` best there are taken from the originals.
TIES = 20
SHORT = 32000.0


def orders() -> list[list[int]]:
    """The digits of every tree in their order: each first once."""
    return [[(t + j) % TREES for j in range(TREES)] for t in range(TREES)]


def _strings(dim: int):
    """A row per vector: its keys as a copy, its hash digits, its 16-bit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _codes.unit_rows(batch, dim):
                digits = np.stack([_codes.strongest(x, AXES, 50 + t)[0] for t in range(TREES)], axis=1).astype(np.int32)
                q = np.rint(x * (SHORT / np.abs(x).max(axis=1))[:, None]).astype("<i2")
                node = batch.column(0).take(pa.array(at))
                packed = pa.array([r.tobytes() for r in q], pa.binary())
                yield pa.RecordBatch.from_arrays([node, *[pa.array(np.ascontiguousarray(digits[:, t])) for t in range(TREES)], packed], ["node", *[f"d{t}" for t in range(TREES)], "short"])

    return run


def _copy_keys(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _codes.unit_rows(batch, dim):
                k1, k2 = _codes.copy_key(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(k1), pa.array(k2)], ["node", "k1", "k2"])

    return run


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("tree", pa.int32()), ("key", pa.string()), ("part", pa.int64()), ("asks", pa.bool_())])


def _within(dim: int, k: int, least: float):
    """Pairs of a block; rows without ``b`` are the vectors of the block that have to be compared again as originals."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        q = np.frombuffer(b"".join(table.column("short").to_pylist()), "<i2").reshape(-1, dim)
        order = np.argsort(node, kind="stable")
        node, asks, q = node[order], asks[order], q[order]
        once = np.concatenate([[True], node[1:] != node[:-1]])
        node, asks, q = node[once], asks[once], q[once]
        x = q.astype(np.float32)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        x /= norm[:, None].astype(np.float32)
        most = min(k + 3, len(node) - 1)
        a, b, c = [], [], []
        tied, near_tied = np.zeros(len(node), bool), np.zeros(len(node), bool)
        wanted = np.flatnonzero(asks)
        step = max(1, (1 << 21) // max(1, len(node)))
        for i in range(0, len(wanted) if most > 0 else 0, step):
            rows = wanted[i : i + step]
            s = x[rows] @ x.T
            s[np.arange(len(rows)), rows] = -2
            hit = np.flatnonzero(s.max(axis=1) >= least - SLACK)
            if not len(hit):
                continue
            s, rows = s[hit], rows[hit]
            if most < s.shape[1]:
                kth = np.partition(s, s.shape[1] - min(k, most), axis=1)[:, s.shape[1] - min(k, most)]
            else:
                kth = s.min(axis=1)
            kept = s >= np.maximum(kth - SLACK, least - SLACK)[:, None]
            many = kept.sum(axis=1) > max(TIES, k)
            tied[rows[many]] = True
            near_tied |= kept[many].any(axis=0)
            r, near = np.nonzero(kept & ~many[:, None])
            a.append(rows[r])
            b.append(near)
        if not a:
            return FOUND.empty_table()
        a, b = np.concatenate(a), np.concatenate(b)
        for i in range(0, len(a), 4096):
            c.append(np.einsum("ij,ij->i", q[a[i : i + 4096]].astype(np.float64), q[b[i : i + 4096]].astype(np.float64)))
        cosine = np.concatenate(c) / (norm[a] * norm[b]) if c else np.zeros(0)
        again = np.flatnonzero(tied | near_tied)
        n, m = len(a), len(again)
        place = [pa.concat_arrays([pa.nulls(n, FOUND.field(f).type), pa.repeat(table.column(f)[0], m).cast(FOUND.field(f).type)]) for f in ("tree", "key", "part")]
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([node[a], node[again]])), pa.concat_arrays([pa.array(node[b]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(cosine), pa.nulls(m, pa.float64())]), *place, pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(tied[again])])],
            schema=FOUND,
        )

    return run


def _within_exactly(dim: int, k: int, least: float):
    """The ``k`` best of every asking vector of a block by rounded cosine of the originals, equal ones by lower node."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("a").to_numpy()
        order = np.argsort(node, kind="stable")
        node, asks = node[order], table.column("asks").to_numpy(zero_copy_only=False).astype(bool)[order]
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)[order]
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        a, b, c = [], [], []
        wanted = np.flatnonzero(asks)
        most = min(k, len(node) - 1)
        for i in range(0, len(wanted) if most > 0 else 0, step := max(1, (1 << 20) // len(node))):
            rows = wanted[i : i + step]
            cosine = np.round(x[rows] @ x.T, 6)
            cosine[np.arange(len(rows)), rows] = -2
            # cosine first, then the lower node, as one number
            rank = np.rint(cosine * 1e6).astype(np.int64) * len(node) - np.arange(len(node))
            best = np.argpartition(rank, len(node) - most, axis=1)[:, len(node) - most :]
            near = np.take_along_axis(cosine, best, 1)
            good = near >= least
            a.append(np.broadcast_to(node[rows][:, None], best.shape)[good])
            b.append(node[best[good]])
            c.append(near[good])
        if not a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b)), "cosine": pa.array(np.concatenate(c))})

    return run


def base_depth(n: int, run: int) -> int:
    """Digits after which runs of evenly spread vectors are no longer than ``run``; tells of cost only, the search doesn't ask for it."""
    depth = 1
    while depth < TREES and n > run * (2 * AXES) ** depth:
        depth += 1
    return depth


def _descend(strings: DataFrame, run: int) -> DataFrame:
    """A block (tree, key, part) for every vector and tree, several below a crowded digit; blocks hold some 2 to 4 times ``run`` at most."""
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.array(*[F.col(f"d{d}") for d in order]).alias("digits")) for t, order in enumerate(orders())])).alias("s")
    spread = strings.select("node", "asks", "short", trees).select("node", "asks", "short", "s.tree", "s.digits")
    narrow = strings.select("node", trees).select("node", "s.*")
    prefix = lambda n: F.concat_ws("-", F.slice("digits", 1, n))
    done, crowded = None, narrow.withColumn("parent", F.lit(""))
    blocks: list[DataFrame] = []
    for depth in range(1, TREES + 1):
        counts = crowded.withColumn("prefix", prefix(depth)).groupBy("tree", "parent", "prefix").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "runs")
        hot = counts.where(F.col("n") > run)
        if depth == 1:
            # small runs next to each other ascend to their parent together only below a crowded one
            small = counts.where(F.col("n") <= run).withColumn("part", F.lit(0).cast("long")).withColumn("key", F.col("prefix"))
        else:
            order = Window.partitionBy("tree", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
            before = F.coalesce(F.sum("n").over(order), F.lit(0))
            small = counts.where(F.col("n") <= run).withColumn("part", F.floor(before / run).cast("long")).withColumn("key", F.concat("parent", F.lit("*")))
        blocks.append(small.select("tree", "prefix", F.col("key"), "part", F.lit(1).cast("long").alias("parts")))
        if is_empty(hot):
            break
        if depth == TREES:
            # strings that are equal to the end: their vectors are put into parts by chance
            blocks.append(hot.select("tree", "prefix", F.concat("prefix", F.lit("=")).alias("key"), F.lit(-1).cast("long").alias("part"), F.ceil(F.col("n") / run).cast("long").alias("parts")))
            break
        crowded = crowded.withColumn("prefix", prefix(depth)).join(hot.select("tree", "prefix"), ["tree", "prefix"], "left_semi").withColumn("parent", F.col("prefix")).drop("prefix")
    if len(blocks) == 1:
        return spread.select("node", "asks", "short", "tree", prefix(1).alias("key"), F.lit(0).cast("long").alias("part"))
    table = blocks[0]
    for b in blocks[1:]:
        table = table.union(b)
    deep = table.where(F.size(F.split("prefix", "-")) > 1).withColumn("prefix1", F.substring_index("prefix", "-", 1))
    deep = materialize(deep.withColumn("subs", F.when(F.col("part") < 0, F.col("parts")).otherwise(1)), "deep")
    # the parts below the first digit are numbered in the order of their strings
    once = deep.groupBy("tree", "prefix1", "key", "part").agg(F.max("subs").alias("subs"))
    order = Window.partitionBy("tree", "prefix1").orderBy("key", "part")
    numbered = once.withColumn("base", F.coalesce(F.sum("subs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.withColumn("total", F.sum("subs").over(Window.partitionBy("tree", "prefix1")))
    places = materialize(deep.drop("subs").join(numbered, ["tree", "prefix1", "key", "part"]).select("tree", "prefix1", "prefix", "base", "subs", "total"), "places")
    deepest = min(len(blocks), TREES)
    # a vector whose first digit is not crowded needs no look-up; the others find their prefix by length
    first = materialize(places.select("tree", "prefix1").distinct(), "crowded")
    out = spread.withColumn("prefix1", prefix(1)).join(first.withColumn("deep", F.lit(True)), ["tree", "prefix1"], "left")
    plain = out.where("deep is null").select("node", "asks", "short", "tree", F.col("prefix1").alias("key"), F.lit(0).cast("long").alias("part"))
    tried = out.where("deep").withColumn("prefix", F.explode(F.array(*[prefix(n) for n in range(2, deepest + 1)])))
    found = tried.join(places.drop("prefix1"), ["tree", "prefix"])
    own = (F.col("base") + F.pmod(F.xxhash64("node", "tree"), F.col("subs"))).cast("long")
    # ascending to the first digit again: every part meets every other one, two parts at a time
    met = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("total") - 1).cast("long"))))
    pair = F.concat_ws("|", "prefix1", F.least("own", "other"), F.greatest("own", "other"))
    return plain.union(met.select("node", "asks", "short", "tree", pair.alias("key"), F.lit(0).cast("long").alias("part")))


def exact_cosines(pairs: DataFrame, source: DataFrame, dim: int) -> DataFrame:
    """(a, b, cosine) from the original embeddings, in double and rounded to 6 decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(n).cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for n in ("x", "y"))
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(c, 6))], ["a", "b", "cosine"])

    x = source.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
    y = source.select(F.col("node").alias("b"), F.col("embedding").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cosine double").distinct()


def neighbours(
    vectors: DataFrame, node: str = "vec_id", embedding: str = "embedding", dim: int = 384, k: int = K, least: float = MIN_COSINE,
    queries: str | None = None, exact: bool = False, run: int = RUN,
) -> DataFrame:
    """``a``, ``b``, ``cosine``, ``place``: the ``k`` nearest other vectors of each, of ``least`` cosine or more.

    Equal cosines (6 decimals) are taken by lower node.  ``queries`` is a condition on ``node`` that
    selects the vectors that ask; all are searched.  Rows with a null node or an unusable embedding
    take no part, rows repeated under one node count once, an empty table gives no rows.  Vectors
    that agree to six decimals are searched once; only their six lowest nodes can be anyone's
    neighbours.  With ``exact`` the cosines returned are those of the original embeddings, else they
    may be off by ``SLACK`` except where that would change a rank.
    """
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(F.col(node).cast("long").alias("node"), F.col(embedding).alias("embedding")).where("node is not null and embedding is not null")
    asking = F.expr(queries) if queries else F.lit(True)
    keys = source.mapInArrow(_copy_keys(dim), "node long, k1 long, k2 long")
    copies = materialize(first_of_key(keys, ["k1", "k2"], "node").select("node", "first").distinct(), "copies")
    repeated = copies.where("node <> first").select("node")
    heads = copies.where(asking).select(F.col("first").alias("node")).distinct()
    schema = "node long, " + ", ".join(f"d{t} int" for t in range(TREES)) + ", short binary"
    once = source.join(repeated, "node", "left_anti")
    strings = once.mapInArrow(_strings(dim), schema)
    if queries:
        strings = strings.join(heads.withColumn("head", F.lit(True)), "node", "left").withColumn("asks", asking | F.col("head").isNotNull()).drop("head")
    else:
        strings = strings.withColumn("asks", F.lit(True))
    blocks = _descend(strings, run)
    found = blocks.groupBy("tree", "key", "part").applyInArrow(_within(dim, k, least), "a long, b long, cosine double, tree int, key string, part long, asks boolean")
    found = materialize(found.groupBy("a", "b", "tree", "key", "part", "asks").agg(F.max("cosine").alias("cosine")), "found")
    pairs, tied = found.where("b is not null").select("a", "b", "cosine"), found.where("b is null").select("a", "tree", "key", "part", "asks")
    if not is_empty(tied):
        ids = materialize(tied.select(F.col("a").alias("node")).distinct(), "tied")
        few = materialize(source.join(ids, "node", "left_semi").dropDuplicates(["node"]), "tied_embeddings")
        again = tied.join(few.withColumnRenamed("node", "a"), "a").groupBy("tree", "key", "part").applyInArrow(_within_exactly(dim, k, least), "a long, b long, cosine double")
        pairs = materialize(pairs.union(again).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "pairs")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = pairs.withColumn("place", F.row_number().over(order))
    edge = Window.partitionBy("a")
    kth = F.max(F.when(F.col("place") == k, F.col("cosine"))).over(edge)
    near = ranked.withColumn("kth", kth).where(F.coalesce(F.col("cosine") >= F.col("kth") - SLACK, F.lit(True)))
    doubt = (F.max("place").over(edge) > k) | (F.min(F.abs(F.col("cosine") - least)).over(edge) <= SLACK)
    near = materialize(near.withColumn("doubt", doubt | F.lit(exact)), "near")
    sure = near.where("not doubt").select("a", "b", F.round("cosine", 6).alias("cosine"))
    open_ = near.where("doubt").select("a", "b")
    if not is_empty(open_):
        # only the embeddings that are asked for are moved
        ids = materialize(open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct(), "asked")
        few = materialize(source.join(ids, "node", "left_semi").dropDuplicates(["node"]), "asked_embeddings")
        sure = sure.union(exact_cosines(open_, few, dim).where(F.col("cosine") >= least))
    if not is_empty(copies):
        sure = _with_copies(sure, copies, k, asking)
    return sure.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _with_copies(found: DataFrame, copies: DataFrame, k: int, asking) -> DataFrame:
    """Put back the vectors left out as copies: as neighbours the lowest k + 1 of each set, and all as askers."""
    low = Window.partitionBy("first").orderBy("node")
    lowest = materialize(copies.withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1).select("first", "node"), "lowest")
    near = found.join(lowest.select(F.col("first").alias("b"), "node"), "b", "left").select("a", F.coalesce("node", "b").alias("b"), "cosine")
    same = lowest.select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    best = near.union(same).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("a", "b", "cosine")
    sets = best.groupBy("a").agg(F.collect_list(F.struct("b", "cosine")).alias("near"))
    asks = copies.where(asking).where("node <> first").select("node", F.col("first").alias("a"))
    salted = asks.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(32)))
    handed = sets.join(copies.select(F.col("first").alias("a")).distinct(), "a", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    others = salted.join(handed, ["a", "salt"]).select(F.col("node").alias("a"), F.explode("near").alias("n")).select("a", "n.b", "n.cosine")
    own = best.where(F.expr("true"))
    return own.union(others).where("a <> b")
