"""Problem 7: filling containers by a grouping genetic algorithm on islands.

Items are dealt out to shards of some ``SHARD`` items by hash, and every shard lives on ``ISLANDS``
islands.  An individual is a grouping of the shard's items into containers.  Crossover injects whole
well-filled containers of one parent into the other, removes the containers that hold an injected
item, and puts displaced items where they fit best.  After each epoch an island's best individual
migrates to the next island.  The best individual of a shard keeps its well-filled containers; what
is left of all shards is dealt out anew and packed once more.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import _tokens
from passagework.runtime import is_empty, materialize, ship

SHARD = 2000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 8
#: Containers filled to this share of the capacity are kept; the others are packed anew once.
WELL_FILLED = 0.995


class Grouping:
    """Container of every item, and how full every container is."""

    def __init__(self, sizes: np.ndarray, capacity: int, bin_of: np.ndarray):
        self.bin_of = np.unique(bin_of, return_inverse=True)[1].astype(np.int64) if len(bin_of) else bin_of
        self.fill = np.bincount(self.bin_of, weights=sizes, minlength=0).astype(np.int64)
        share = self.fill / capacity
        self.fitness = float((share * share).mean()) if len(share) else 1.0


def best_fit(sizes: np.ndarray, capacity: int, bin_of: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Put ``items`` in the given order into the container with the least room that is enough."""
    fixed = bin_of >= 0
    n = int(bin_of.max(initial=-1)) + 1
    fill = np.bincount(bin_of[fixed], weights=sizes[fixed], minlength=n).astype(np.int64)
    used = np.zeros(n, bool)
    used[bin_of[fixed]] = True
    room = sorted((capacity - int(fill[b]), b) for b in np.flatnonzero(used))
    out = bin_of.copy()
    for i in items.tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, n
            n += 1
        out[i] = b
        if free > s or s == 0:
            insort(room, (free - s, b))
    return out


def crossover(a: Grouping, b: Grouping, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Grouping:
    """Child of ``a`` with some of the best-filled containers of ``b``."""
    best = np.argsort(-b.fill, kind="stable")[: max(1, len(b.fill) // 2)]
    injected = rng.choice(best, max(1, int(len(best) * rng.uniform(0.3, 0.9))), replace=False)
    chosen = np.isin(b.bin_of, injected)
    hit = np.zeros(len(a.fill), bool)
    hit[a.bin_of[chosen]] = True
    child = np.where(hit[a.bin_of], -1, a.bin_of)
    displaced = np.flatnonzero((child < 0) & ~chosen)
    child[chosen] = len(a.fill) + b.bin_of[chosen]
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    return Grouping(sizes, capacity, best_fit(sizes, capacity, child, displaced))


def mutate(a: Grouping, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Grouping:
    """Empty the least filled containers and a few others, and put their items where they fit best."""
    order = np.argsort(a.fill, kind="stable")
    gone = order[: max(1, len(order) // 20)]
    gone = np.concatenate([gone, rng.choice(order, max(1, len(order) // 20))])
    open_ = np.isin(a.bin_of, gone)
    child = np.where(open_, -1, a.bin_of)
    items = np.flatnonzero(open_)
    items = items[np.argsort(-sizes[items] * rng.uniform(0.8, 1.0, len(items)), kind="stable")]
    return Grouping(sizes, capacity, best_fit(sizes, capacity, child, items))


def evolve(sizes: np.ndarray, capacity: int, seed: int, migrants: list[np.ndarray] = (), generations: int = GENERATIONS) -> Grouping:
    """Best grouping after some generations; ``migrants`` are groupings from other islands."""
    rng = np.random.default_rng(seed)
    empty = np.full(len(sizes), -1, np.int64)
    people = [Grouping(sizes, capacity, m) for m in migrants]
    while len(people) < POPULATION:
        noise = np.ones(len(sizes)) if not people else rng.uniform(0.7, 1.0, len(sizes))
        people.append(Grouping(sizes, capacity, best_fit(sizes, capacity, empty, np.argsort(-sizes * noise, kind="stable"))))
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        best = max(people, key=lambda g: g.fitness)
        if len(best.fill) <= max(1, least):
            return best
        for _ in range(POPULATION // 2):
            i, j = rng.choice(len(people), 2, replace=False)
            child = crossover(people[i], people[j], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, sizes, capacity, rng)
            worst = min(range(len(people)), key=lambda k: people[k].fitness)
            if child.fitness > people[worst].fitness:
                people[worst] = child
    return max(people, key=lambda g: g.fitness)


ROWS = "pack_name string, capacity long, shard long, island int, doc_id long, piece long, tokens long, container long, fitness double"


def _island(epoch: int):
    def run(table):
        """One island of one shard; from the second epoch on with its own and one migrant grouping."""
        col = {c: table.column(c).to_numpy() for c in ("doc_id", "piece", "tokens", "container", "origin")}
        order = np.lexsort((col["piece"], col["doc_id"], col["origin"]))
        col = {k: v[order] for k, v in col.items()}
        origins = np.unique(col["origin"])
        n = len(order) // len(origins)
        sizes, capacity = col["tokens"][:n], int(table.column("capacity")[0].as_py())
        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        migrants = [] if epoch == 0 else [col["container"][k * n : (k + 1) * n] for k in range(len(origins))]
        best = evolve(sizes, capacity, [epoch, shard, island, capacity], migrants)
        return pa.table(
            {
                "pack_name": table.column("pack_name").take(pa.array(np.zeros(n, np.int64))).cast(pa.string()), "capacity": pa.array(np.full(n, capacity)), "shard": pa.array(np.full(n, shard)),
                "island": pa.array(np.full(n, island, np.int32)), "doc_id": pa.array(col["doc_id"][:n]), "piece": pa.array(col["piece"][:n]), "tokens": pa.array(sizes), "container": pa.array(best.bin_of),
                "fitness": pa.array(np.full(n, best.fitness)),
            }
        )

    return run


def _pack(items: DataFrame, turn: int) -> DataFrame:
    """Best grouping of every shard: pack_name, capacity, doc_id, piece, tokens, shard, container."""
    shards = items.groupBy("pack_name").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("long").alias("shards"))
    dealt = items.join(shards, "pack_name").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.col("shards"))).drop("shards")
    state = dealt.withColumn("container", F.lit(-1).cast("long")).withColumn("origin", F.lit(0)).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    for epoch in range(EPOCHS):
        state = materialize(state.groupBy("pack_name", "shard", "island").applyInArrow(_island(epoch), ROWS), f"epoch{epoch}")
        if epoch + 1 < EPOCHS:
            target = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
            state = state.withColumn("origin", F.col("island")).withColumn("island", target)
    best = state.groupBy("pack_name", "shard").agg(F.max_by("island", F.struct("fitness", -F.col("island"))).alias("island"))
    return state.join(best, ["pack_name", "shard", "island"]).select("pack_name", "capacity", "doc_id", "piece", "tokens", "shard", "container")


def pack(documents: DataFrame, packs: DataFrame, node: str = "doc_id", text: str = "text", path: str = _tokens.RANKS) -> DataFrame:
    """Container and position of every document, or of its pieces, for each capacity.

    ``pack_name, container, position, doc_id, piece, tokens, unused``: only documents over the
    capacity are split, into pieces of the capacity (piece p starts at token p * capacity) and a
    rest.  Documents without text have 0 tokens and take a place in some container.  Rows without
    id, and packs without a name or a positive capacity, are left out; a pack given twice counts
    once with its larger capacity.  Empty tables give no rows.
    """
    ship(documents.sparkSession)
    packs = packs.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    sizes = [(r["pack_name"], r["capacity"]) for r in packs.collect()]
    counts = materialize(_tokens.token_counts(documents, node, text, path), "tokens")
    if not sizes:
        return counts.select(F.lit("").alias("pack_name"), F.lit(0).cast("long").alias("container"), F.lit(0).alias("position"), "doc_id", F.lit(0).cast("long").alias("piece"), "tokens", F.lit(0).cast("long").alias("unused")).where("false")
    each = counts.withColumn("p", F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sizes]))).select("doc_id", "tokens", "p.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("long") - 1, F.lit(0).cast("long"))
    items = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    items = items.select("pack_name", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))
    full = items.where("tokens = capacity").select("pack_name", "capacity", "doc_id", "piece", "tokens", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"))
    first = materialize(_pack(items.where("tokens < capacity"), 0), "packed")
    name = lambda turn: F.concat_ws("-", F.lit(turn), "shard", "container").alias("container")
    fills = first.groupBy("pack_name", "shard", "container").agg((F.sum("tokens") / F.max("capacity")).alias("fill"))
    marked = first.join(fills, ["pack_name", "shard", "container"])
    kept = marked.where(F.col("fill") >= WELL_FILLED).select("pack_name", "capacity", "doc_id", "piece", "tokens", name("a"))
    left = materialize(marked.where(F.col("fill") < WELL_FILLED).select("pack_name", "capacity", "doc_id", "piece", "tokens"), "left")
    out = full.union(kept)
    if not is_empty(left):
        out = out.union(_pack(left, 1).select("pack_name", "capacity", "doc_id", "piece", "tokens", name("b")))
    from pyspark.sql import Window

    inside = Window.partitionBy("pack_name", "container")
    place = F.row_number().over(inside.orderBy(F.desc("tokens"), "doc_id", "piece"))
    return out.select("pack_name", "container", place.alias("position"), "doc_id", "piece", "tokens", (F.col("capacity") - F.sum("tokens").over(inside)).alias("unused"))
