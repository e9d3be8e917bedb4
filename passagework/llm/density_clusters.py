"""Problem 2: sets of mutually similar vectors, by grid density clustering in SQL.

Every vector's features are quantised: the strongest axis of a random rotation is one quantised
feature.  A cell is given by ``DEPTH`` of the features of a turn; cells are counted, and
those with ``DENSE`` vectors or more are dense.  Two dense cells are adjacent if a vector lies in
both: each vector is tied to the lowest vector of the cell that it resembles most, and that one to
the lowest vectors of its other dense cells.  Ties count where the sign sketches agree, or nearly
agree and the vectors reach the limit as 16-bit numbers.  Vectors without a lower neighbour take
another turn with other features.  Minimum labels are propagated along the ties until nothing
changes.  At last every member is compared with the lowest vector of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import _codes
from passagework.llm._graph import components, first_of_key
from passagework.runtime import is_empty, materialize, ship

#: Features of each turn: few find nearly all members of larger sets, more are spent on what is left.
TURNS = (6, 9, 9)
DEPTH = 3
DENSE = 2
AXES = 128
WORDS = 8
#: Sketches of two vectors may differ in so large a share of their bits; 0.8 as cosine is 0.205.
DIFFER = 0.225
#: Up to here they are compared themselves; at 0.8 one pair in 50,000 or so differs in more.
DOUBT = 0.28
#: Up to here a member belongs to its root without a closer look; at a cosine of 0.7 one pair in 500 or so does.
SURE = 0.195
MIN_COSINE = 0.8
#: Bits of the first word of the sketches in which a vector and the lowest one of its cell may differ; 13 are expected at 0.8, 32 by chance.
NEAR = 24
#: Cosines of 16-bit vectors are off by less than this.
SLACK = 1e-5
#: Vectors whose cells are counted together where they are read.
PART = 1 << 16


def _features(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "k1", "k2", *[f"f{g}" for g in range(sum(TURNS))], *[f"s{w}" for w in range(WORDS)]]
        for batch in batches:
            for at, x in _codes.unit_rows(batch, dim):
                coded = [_codes.strongest(x, AXES, g) for g in range(sum(TURNS))]
                signs = np.concatenate([s for _, s in coded[: 64 * WORDS // AXES]], axis=1)[:, : 64 * WORDS]
                words = np.packbits(signs, axis=1).view(np.int64)
                k1, k2 = _codes.copy_key(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(k1), pa.array(k2), *[pa.array(c.astype(np.int32)) for c, _ in coded], *[pa.array(np.ascontiguousarray(words[:, w])) for w in range(WORDS)]], names
                )

    return run


SHORT = 32000.0


def _short(dim: int):
    """Unit vectors as 16-bit numbers, for the comparison in the end (off by less than 1e-5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _codes.unit_rows(batch, dim):
                q = np.rint(x * (SHORT / np.abs(x).max(axis=1))[:, None]).astype("<i2")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in q], pa.binary())], ["node", "short"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i2").reshape(batch.num_rows, -1).astype(np.float64) for c in ("short", "root_short"))
        c = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(c)], ["node", "root", "cosine"])


def _cell_keys(batch: pa.Table) -> np.ndarray:
    """Cells of all rows, grid after grid: the number of the grid and its features, 31 bits in all."""
    f = [batch.column(c).to_numpy().astype(np.int32) for c in batch.column_names if c.startswith("f")]
    keys = []
    for i, grid in enumerate(combinations(range(len(f)), DEPTH)):
        k = np.full(batch.num_rows, i, np.int32)
        for g in grid:
            k = k * np.int32(2 * AXES) + f[g]
        keys.append(k)
    return np.concatenate(keys)


def _ties(low: np.ndarray, node: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Pairs that tie each node to the low it resembles most, and that one to the node's other lows."""
    order = np.lexsort((low, differ, node))
    low, node = low[order], node[order]
    first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
    best = low[first][np.cumsum(first) - 1] if len(node) else low
    other = ~first & (low != best)
    pairs = np.concatenate([np.stack([low[first], node[first]]), np.stack([np.minimum(best, low)[other], np.maximum(best, low)[other]])], axis=1)
    return np.unique(pairs, axis=1)


def _part_cells(ties: bool):
    """Cells counted within a part of the rows: either (cell, low, code, n) or ties (a, b) within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = _cell_keys(table)
            at = np.tile(np.arange(table.num_rows), len(keys) // table.num_rows)
            all_nodes, all_codes = table.column("node").to_numpy(), table.column("s0").to_numpy()
            order = np.lexsort((all_nodes[at], keys))
            keys, at = keys[order], at[order]
            node, code = all_nodes[at], all_codes[at]
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.concatenate([cut, [len(keys)]]))
            if not ties:
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(node[cut]), pa.array(code[cut]), pa.array(n.astype(np.int32))], ["cell", "low", "code", "n"])
                return
            low = np.repeat(node[cut], n)
            differ = np.bitwise_count((code ^ np.repeat(code[cut], n)).view(np.uint64))
            near = (low != node) & (differ <= NEAR)
            pairs = _ties(low[near], node[near], differ[near])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= PART:
                yield from done()
                held.clear()
        if held:
            yield from done()

    return run


def _pairs(points: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), a the lower one, of vectors that lie in one dense cell or in adjacent ones.

    Rows are counted where they are read, so of a cell that holds a third of all vectors only one
    row per ``PART`` vectors is moved.
    """
    source = points.select("node", "s0", *[f"f{g}" for g in range(sum(TURNS[:turn]), sum(TURNS[: turn + 1]))])
    inside = source.mapInArrow(_part_cells(True), "a long, b long")
    cells = source.mapInArrow(_part_cells(False), "cell int, low long, code long, n int")
    cell = Window.partitionBy("cell")
    dense = cells.withColumn("first", F.min(F.struct("low", "code")).over(cell)).withColumn("all", F.sum("n").over(cell)).where(F.col("all") >= DENSE)
    differ = F.bit_count(F.col("code").bitwiseXOR(F.col("first.code")))
    met = dense.select(F.col("first.low").alias("low"), F.col("low").alias("node"), differ.alias("differ")).where((F.col("low") != F.col("node")) & (F.col("differ") <= NEAR))
    own = Window.partitionBy("node").orderBy("differ", "low")
    tied = met.withColumn("best", F.first("low").over(own))
    between = tied.select(F.least("best", "low").alias("a"), F.when(F.col("best") == F.col("low"), F.col("node")).otherwise(F.greatest("best", "low")).alias("b"))
    return inside.union(between).distinct()


def _density(points: DataFrame) -> DataFrame:
    """``node, density``: number of ``points`` in all the dense cells of the first turn that a vector lies in."""
    cells = [F.struct(F.xxhash64(F.lit(i), *[F.col(f"f{g}") for g in grid]).alias("cell")) for i, grid in enumerate(combinations(range(TURNS[0]), DEPTH))]
    spread = points.select("node", F.explode(F.array(*cells)).alias("c")).select("node", "c.cell")
    return first_of_key(spread, ["cell"], "node").groupBy("node").agg(F.sum("copies").alias("density"))


def _agreeing(pairs: DataFrame, points: DataFrame, source: DataFrame, dim: int) -> DataFrame:
    """Those of ``pairs`` whose sketches agree, or nearly agree while the vectors reach the limit."""
    sketch = points.select("node", *[f"s{w}" for w in range(WORDS)])
    pairs = pairs.join(sketch.withColumnRenamed("node", "b"), "b").withColumnsRenamed({f"s{w}": f"t{w}" for w in range(WORDS)})
    pairs = pairs.join(sketch.withColumnRenamed("node", "a"), "a")
    differ = sum((F.bit_count(F.col(f"s{w}").bitwiseXOR(F.col(f"t{w}"))) for w in range(1, WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    near = materialize(pairs.select("a", "b", differ.alias("differ")).where(F.col("differ") <= int(DOUBT * 64 * WORDS)), "links")
    links = near.where(F.col("differ") <= int(DIFFER * 64 * WORDS)).select("a", "b")
    doubt = near.where(F.col("differ") > int(DIFFER * 64 * WORDS)).select(F.col("b").alias("node"), F.col("a").alias("root"))
    if is_empty(doubt):
        return links
    ids = materialize(doubt.select("node").union(doubt.select("root")).distinct(), "doubtful")
    short = materialize(source.join(ids, "node", "left_semi").mapInArrow(_short(dim), "node long, short binary"), "short")
    both = doubt.join(short, "node").join(short.select(F.col("node").alias("root"), F.col("short").alias("root_short")), "root")
    checked = both.select("node", "root", "short", "root_short").mapInArrow(_cosines, "node long, root long, cosine double")
    return links.union(materialize(checked.where(F.col("cosine") >= MIN_COSINE - SLACK).select(F.col("root").alias("a"), F.col("node").alias("b")), "checked"))


def density_sets(vectors: DataFrame, node: str = "vec_id", embedding: str = "embedding", dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """``(sets, points)``: (node, root, size) of each member, and the features of each usable vector, copies and loners too.

    Rows with a null node or an unusable embedding take no part, loners give no row.  Vectors that
    agree to six decimals are counted and clustered once and come back in the end, so a vector
    stored very often costs no more.  Rows repeated under one node count once.
    """
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(F.col(node).cast("long").alias("node"), F.col(embedding).alias("embedding")).where("node is not null and embedding is not null")
    schema = "node long, k1 long, k2 long, " + ", ".join(f"f{g} int" for g in range(sum(TURNS))) + ", " + ", ".join(f"s{w} long" for w in range(WORDS))
    points = materialize(source.mapInArrow(_features(dim), schema), "features")
    copies = materialize(first_of_key(points.select("node", "k1", "k2"), ["k1", "k2"], "node").where("node <> first").select("node", "first").distinct(), "copies")
    own = points.join(copies.select("node"), "node", "left_anti")
    links = copies.select(F.col("first").alias("a"), F.col("node").alias("b"))
    todo = own
    for turn in range(len(TURNS)):
        found = _agreeing(_pairs(todo, turn), own, source, dim)
        links = links.union(found)
        if turn + 1 < len(TURNS):
            todo = materialize(todo.join(found.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), "left")
    every = points.dropDuplicates(["node"])
    return _exact(components(links), every, source, dim), every


def _exact(sets: DataFrame, points: DataFrame, source: DataFrame, dim: int, chunk: int = 1024) -> DataFrame:
    """(node, root, size) of what holds: members are compared with their root; those below the limit form sets of their own, again checked.

    Members whose sketch differs from the root's in no more than ``SURE`` of the bits belong to it;
    only the others are compared as 16-bit vectors.
    """
    kept = []
    sketch = points.select("node", F.array(*[F.col(f"s{w}") for w in range(WORDS)]).alias("bits"))
    while True:
        sizes = materialize(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        members = sets.join(sizes, "root").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk)).cast("long"))
        members = members.select("node", "root", "salt")
        heads = sizes.select("root", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("n") / chunk) - 1).cast("long"))).alias("salt"))

        def beside(value: DataFrame, some: DataFrame, name: str) -> DataFrame:
            """``some`` members with their own value and their root's, which is handed out once per ``chunk`` of a set."""
            top = heads.join(value.select(F.col("node").alias("root"), F.col(name).alias(f"root_{name}")), "root")
            return some.join(value, "node").join(top, ["root", "salt"])

        differ = F.aggregate(F.zip_with("bits", "root_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        near = materialize(beside(sketch, members, "bits").select("node", "root", "salt", (differ <= int(SURE * 64 * WORDS)).alias("sure")), "near")
        kept.append(near.where("sure").select("node", "root").distinct())
        doubt = near.where("not sure").select("node", "root", "salt")
        if is_empty(doubt):
            break
        ids = materialize(doubt.select("node").union(doubt.select("root")).distinct(), "compared")
        short = materialize(source.join(ids, "node", "left_semi").mapInArrow(_short(dim), "node long, short binary"), "short")
        checked = beside(short, doubt, "short").select("node", "root", "short", "root_short")
        checked = materialize(checked.mapInArrow(_cosines, "node long, root long, cosine double"), "exact")
        kept.append(checked.where(F.col("cosine") >= MIN_COSINE - SLACK).select("node", "root").distinct())
        rest = checked.where(F.col("cosine") < MIN_COSINE - SLACK)
        if is_empty(rest):
            break
        low = rest.groupBy(F.col("root").alias("was")).agg(F.min("node").alias("root"))
        sets = materialize(rest.select("node", F.col("root").alias("was")).join(low, "was").select("node", "root").distinct(), "split")
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    alone = out.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return out.join(alone, "root").select("node", "root", "size")


def cluster_report(vectors: DataFrame, node: str = "vec_id", embedding: str = "embedding", dim: int = 384, typical: int = 3) -> DataFrame:
    """Per set: ``first_vec_id``, ``size`` and the ``typical`` members of the densest cells.

    The density of a vector is the number of vectors in all the dense cells of the first turn that
    it lies in; all usable vectors of the table count there, those stored repeatedly and loners too.
    """
    sets, points = density_sets(vectors, node, embedding, dim)
    density = _density(points)
    # the largest few are kept while rows are read, so that no set is gathered in one place
    dense = sets.join(density, "node", "left").select("root", "size", "node", F.coalesce("density", F.lit(0)).alias("density"))
    order = Window.partitionBy("root").orderBy(F.desc("density"), "node")
    top = dense.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    return top.select(F.col("root").alias("first_vec_id"), "size", "place", F.col("node").alias("vec_id"), "density")
