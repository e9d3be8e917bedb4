"""Problem 8: mixing sources to target weights with soft membership.

A softmax classifier, fitted on documents whose source is known, predicts for documents without a
source how likely each source is; documents with a source belong to it.  Nonnegative rates of the
documents, bounded by the allowed repeats, are fitted by projected gradient least squares, so that
the expected tokens of every source match its share of the largest mix that the repeats allow.
Documents that agree in membership and bound share a rate and are summed up before; each gradient
step is one aggregation over what is left.  Rates become whole uses by a cut through the documents'
random numbers that is chosen from a histogram, so that totals are met without sorting a source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import _tokens
from passagework.runtime import materialize, ship

#: Labelled documents per source that the classifier is fitted on, at most about.
FIT_PER_SOURCE = 400
FEATURES = 4096
#: Rows made dense at once when the classifier is fitted.
DENSE = 1 << 15
#: Gradient steps at most; they end when the targets are met or ``IDLE`` steps bring less than a thousandth.
STEPS = 200
IDLE = 5
#: Classes of documents up to this number are summed up on the driver, more in a job for each step.
LOCAL = 20_000
BINS = 8192
WORD = re.compile(r"\w+|[^\w\s]")


def canonical(source: Column) -> Column:
    """One spelling of a source: lower case, blanks and hyphens as underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")
    return F.when(name != "", name)


def featurize(text: str) -> list[int]:
    """Hashed words, and first words and lengths of lines, each once."""
    out = set()
    for w in WORD.findall(text.lower()):
        out.add(xxhash.xxh32_intdigest(w) % FEATURES)
    lines = text.split("\n")
    out.add(xxhash.xxh32_intdigest(f"lines {min(len(lines), 20)}") % FEATURES)
    for line in lines:
        head = [m.group(0) for m in islice(WORD.finditer(line), 2)]
        if head:
            out.add(xxhash.xxh32_intdigest("head " + re.sub(r"\d+", "0", " ".join(head))) % FEATURES)
    return sorted(out)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([featurize(t or "") for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "source", "features"])


def fit_softmax(rows: list[list[int]], labels: np.ndarray, k: int, steps: int = 150) -> np.ndarray:
    """Weights (features + 1, k) of a softmax classifier of binary features, by full-batch Adam.

    A class without rows is never predicted.
    """
    w = np.zeros((FEATURES + 1, k))
    if not rows or k < 2:
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    f = np.concatenate([np.array([*r, FEATURES]) for r in rows])
    scale = 1 / np.sqrt(np.bincount(at))
    starts = np.arange(0, len(rows), DENSE)
    cuts = np.searchsorted(at, [*starts, len(rows)])

    def dense(i: int) -> np.ndarray:
        x = np.zeros((min(DENSE, len(rows) - starts[i]), FEATURES + 1), np.float32)
        here = slice(cuts[i], cuts[i + 1])
        x[at[here] - starts[i], f[here]] = scale[at[here]]
        return x

    whole = dense(0) if len(starts) == 1 else None
    unseen = np.bincount(labels, minlength=k) == 0
    weight = (len(labels) / (k * np.maximum(1, np.bincount(labels, minlength=k))))[labels]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = 1e-4 * w
        for b, start in enumerate(starts):
            x = dense(b) if whole is None else whole
            z = np.where(unseen, -1e9, x @ w.astype(np.float32))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            own = labels[start : start + DENSE]
            p[np.arange(len(own)), own] -= 1
            g += x.T @ (p * weight[start : start + DENSE, None]).astype(np.float32) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    w[:, unseen] = -1e6
    return w


def _posteriors(w: np.ndarray):
    weights = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.column("features").to_pylist():
                z = weights[[*r, FEATURES]].sum(axis=0) / np.sqrt(len(r) + 1)
                p = np.exp(z - z.max())
                p = np.floor(p / p.sum() * 1000 + 0.5) / 1000  # coarse, so that like documents share a rate
                out.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "p"])

    return run


def memberships(documents: DataFrame, domains: list[str], node: str, text: str, source: str) -> DataFrame:
    """``doc_id, p``: how much each document belongs to each of ``domains`` (the last is "", any other source)."""
    rows = documents.select(F.col(node).cast("long").alias("doc_id"), canonical(F.col(source)).alias("source"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    known = F.array(*[F.lit(d) for d in domains[:-1]])
    place = F.array_position(known, F.col("source"))
    index = F.when(place > 0, place).otherwise(len(domains)).cast("int")
    hard = rows.where("source is not null").select("doc_id", F.transform(F.sequence(F.lit(1), F.lit(len(domains))), lambda i: (i == index).cast("double")).alias("p"))
    counts = {r["i"]: r["n"] for r in rows.where("source is not null").groupBy((index - 1).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.element_at(F.array(*[F.lit(min(1.0, FIT_PER_SOURCE / counts.get(i, 1))) for i in range(len(domains))]), index)
    picked = rows.where("source is not null and text is not null").where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < rate * 1_000_000)
    sample = picked.select("doc_id", (index - 1).cast("string").alias("source"), "text").mapInArrow(_features, "doc_id long, source string, features array<int>").limit(2 * FIT_PER_SOURCE * len(domains)).collect()
    w = fit_softmax([r["features"] for r in sample], np.array([int(r["source"]) for r in sample], int), len(domains))
    soft = rows.where("source is null").select("doc_id", "source", "text").mapInArrow(_features, "doc_id long, source string, features array<int>").mapInArrow(_posteriors(w), "doc_id long, p array<double>")
    return hard.union(soft)


def _step(p: np.ndarray, history: list[np.ndarray], cap: np.ndarray) -> np.ndarray:
    """Rates after all steps so far, replayed from the scaled residuals of each step."""
    r = np.zeros(len(p))
    for g in history:
        r = np.clip(r - p @ g, 0, cap)
    return r


def _expected(history: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.array(batch.column("p").to_pylist())
            r = _step(p, history, batch.column("cap").to_numpy().astype(float))
            total = (r * batch.column("tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "tokens"])

    return run


def _rates(history: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("p").to_pylist()) if batch.num_rows else np.zeros((0, 1))
            r = _step(p, history, batch.column("cap").to_numpy().astype(float)) if batch.num_rows else np.zeros(0)
            keep = ["doc_id", "tokens", "domain", "cap"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(r)], [*keep, "rate"])

    return run


def _totals(classes: DataFrame, k: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Expected tokens of each domain after a history of steps; the same numbers for few classes and for many."""
    if classes.limit(LOCAL + 1).count() <= LOCAL:
        held = classes.toArrow()
        p = held.column("p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        cap, tokens = (held.column(c).to_numpy().astype(float) for c in ("cap", "tokens"))
        return lambda history: (_step(p, history, cap) * tokens) @ p

    def spread(history: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(k)
        for r in classes.mapInArrow(_expected(history), "i int, tokens double").groupBy("i").agg(F.sum("tokens").alias("t")).collect():  # one row for each domain
            total[r["i"]] = r["t"]
        return total

    return spread


def fit_rates(classes: DataFrame, share: np.ndarray, caps: np.ndarray, steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """History of scaled residuals and the target tokens of each domain."""
    k = len(share)
    totals = _totals(classes, k)
    most = totals([np.full(k, -1e9)])
    there = (share > 0) & (most > 0)
    if not there.any():
        return [], np.zeros(k)
    wanted = np.where(there, share, 0) / share[there].sum()
    target = wanted * (most[there] / wanted[there]).min()
    available = most / np.maximum(caps, 1)
    history: list[np.ndarray] = []
    total, misses = np.zeros(k), []
    for _ in range(steps):
        gap = np.where(available > 0, (total - target) / np.maximum(available, 1e-9), 0)
        gap = np.where(there | (total > 0), gap, 0)
        misses.append(np.abs(total - target).sum())
        if misses[-1] <= 1e-4 * target.sum() or len(misses) > IDLE and misses[-1] > 0.999 * misses[-1 - IDLE]:
            break
        history.append(gap)
        total = totals(history)
    return history, target


def mix(documents: DataFrame, targets: DataFrame, node: str = "doc_id", text: str = "text", source: str = "source", path: str = _tokens.RANKS) -> DataFrame:
    """``mix_name, source, doc_id, tokens, uses`` of every drawn document, for every mix.

    The source is the document's own, in one spelling, or the likeliest one where it has none.
    Sources without documents leave their share to the others in proportion; sources that are not
    listed are not drawn.  A mix is as large as the allowed repeats let it be.  Documents without
    tokens are not drawn; rows of ``targets`` with a null name or source, or without a positive
    share and repeats, are left out; a source listed twice in a mix counts with the sum of its
    shares and the larger repeats.  Rows repeated under one doc_id count once.
    """
    spark = documents.sparkSession
    ship(spark)
    listed = targets.select("mix_name", canonical(F.col("source")).alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0")
    listed = listed.groupBy("mix_name", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("mix_name", "source").collect()
    names = sorted({r["source"] for r in listed})
    domains = [*names, ""]
    tokens = _tokens.token_counts(documents, node, text, path)
    p = memberships(documents, domains, node, text, source).dropDuplicates(["doc_id"])
    docs = tokens.where("tokens > 0").join(p, "doc_id")
    docs = materialize(docs.withColumn("domain", (F.array_position("p", F.array_max("p")) - 1).cast("int")), "memberships")
    classes = materialize(docs.groupBy("p", "domain").agg(F.sum("tokens").alias("tokens")), "classes")
    drawn = None
    for name in sorted({r["mix_name"] for r in listed}):
        share, caps = np.zeros(len(domains)), np.zeros(len(domains))
        for r in listed:
            if r["mix_name"] == name:
                share[names.index(r["source"])], caps[names.index(r["source"])] = r["share"], r["cap"]
        cap = F.element_at(F.array(*[F.lit(int(c)) for c in caps]), F.col("domain") + 1).alias("cap")
        history, target = fit_rates(classes.select("p", "tokens", cap), share, caps)
        rated = docs.select("doc_id", "tokens", "domain", cap, "p").mapInArrow(_rates(history), "doc_id long, tokens long, domain int, cap int, rate double")
        # a document is used once more than its whole rate if its lot is below its fraction plus the source's correction
        lot = F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
        base = F.floor(F.col("rate") + 1e-9)
        rated = materialize(rated.withColumn("base", base.cast("int")).withColumn("edge", F.when(base < F.col("cap"), lot - (F.col("rate") - base))).where("cap > 0"), "rates")
        cuts = _cuts(rated, target, len(domains))
        cut = F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), F.col("domain") + 1)
        uses = F.col("base") + F.coalesce(F.col("edge") < cut, F.lit(False)).cast("int")
        label = F.element_at(F.array(*[F.lit(d) for d in domains]), F.col("domain") + 1)
        part = rated.select(F.lit(name).alias("mix_name"), label.alias("source"), "doc_id", "tokens", uses.alias("uses")).where("uses > 0")
        drawn = part if drawn is None else drawn.union(part)
    if drawn is None:
        return docs.select(F.lit("").alias("mix_name"), F.lit("").alias("source"), "doc_id", "tokens", F.lit(0).alias("uses")).where("false")
    return drawn


def _cuts(rated: DataFrame, target: np.ndarray, k: int) -> np.ndarray:
    """For each domain the cut through ``edge`` at which its drawn tokens come closest to its target."""
    base = {r["domain"]: r["t"] for r in rated.groupBy("domain").agg(F.sum(F.col("base") * F.col("tokens")).alias("t")).collect()}
    bin_ = F.floor((F.col("edge") + 1) * (BINS / 2)).cast("int")
    rows = rated.where("edge is not null").groupBy("domain", bin_.alias("bin")).agg(F.sum("tokens").alias("t")).collect()
    out = np.full(k, -2.0)
    of: dict[int, list] = {}
    for r in rows:
        of.setdefault(r["domain"], []).append(r)
    for d in range(k):
        h = np.zeros(BINS + 1)
        for r in of.get(d, []):
            h[min(max(r["bin"], 0), BINS)] += r["t"]
        total = (base.get(d) or 0) + np.concatenate([[0], np.cumsum(h)])
        out[d] = int(np.abs(total - target[d]).argmin()) / (BINS / 2) - 1
    return out


def shares(documents: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, actual_share, tokens, documents, uses`` of every listed source."""
    listed = targets.select("mix_name", canonical(F.col("source")).alias("source"), "target_share").where("mix_name is not null and source is not null and target_share > 0")
    listed = listed.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    by = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"))
    whole = by.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    out = listed.join(by, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("documents"), zero("uses"))
