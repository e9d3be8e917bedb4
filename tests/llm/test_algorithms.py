"""Brute-force comparisons, edge cases and hot groups of the operators on algorithms."""

import itertools
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, same
from conftest import SF
from passagework.llm import density_clusters, format_duplicates, prefix_forest, queries, sparse_product, text_pieces
from passagework.llm._graph import components, first_of_key


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF)


# groups


def test_components_of_chains_stars_and_repeats(spark, rows):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (10, 12), (20, 20), (12, 13)] + [(100 + i, 101 + i) for i in range(20)]
    got = rows(components(spark.createDataFrame(links, "a long, b long")))
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10), (13, 10)} | {(100 + i, 100) for i in range(21)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_a_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    got = first_of_key(df, ["k"], "node")
    assert got.count() == 1000 and got.agg(F.max("first"), F.min("copies")).collect()[0] == (0, 1000)


# formatting

TEXTS = [
    (1, "Hello, World 1"), (2, "hello world-1"), (3, "HELLOWORLD1"), (4, "hello world 2"), (5, None), (6, ""), (7, " .,-"), (8, "é a"), (9, "e a"), (10, "Name: Ann; Town: Bonn; Age: 3"),
    (11, "age=3 | name=ANN\nTown = bonn"), (12, "Town: Bonn, Age: 3; Name: Ann"), (13, "a:1;b:2"), (14, "b:2;a:1"), (15, "Straße"), (16, "STRASSE"), (None, "hello world 1"), (1, "Hello, World 1"),
]
COPIES = {(1, 2), (1, 3), (10, 11), (15, 16)}


def test_format_duplicates(spark, rows):
    df = spark.createDataFrame([(o, t, "x", 0) for o, t in TEXTS], "ordinal long, text string, first string, hash int")
    assert rows(format_duplicates.format_duplicates(df).select("first", "node")) == COPIES
    assert format_duplicates.format_duplicates(df.limit(0)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    monkeypatch.setattr(format_duplicates, "BLOCK", 8)
    format_duplicates.powers.cache_clear()
    a, b = "Some Words, that are long enough. " * 5, "some words that are long enough " * 5
    (x, y), n = format_duplicates.hash_texts([a, b])
    assert x == y and n[0] == n[1]
    short, _ = format_duplicates.hash_texts(["some"])
    assert short[0] == format_duplicates.hash_texts(["S.o-m e"])[0][0]
    assert format_duplicates.same_passage(a, b) and not format_duplicates.same_passage(a, b + "x")
    format_duplicates.powers.cache_clear()


def test_a_hash_that_collides_is_told_apart(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, f"word {i % 3}") for i in range(9)], "ordinal long, text string")
    real = format_duplicates._keys

    def bad(seed):
        return (lambda batches: ((b.set_column(1, "hash", b.column(1).fill_null(0).__class__.from_pandas([0] * b.num_rows))) for b in real(seed)(batches))) if seed == 0 else real(seed)

    monkeypatch.setattr(format_duplicates, "_keys", bad)
    assert rows(format_duplicates.format_duplicates(df).select("first", "node")) == {(i % 3, i) for i in range(3, 9)}


# vectors


def clustered(seed=0, dim=48, hot=60):
    rng = np.random.default_rng(seed)
    out, truth, n = [], [], 0
    for size in (hot, 7, 5, 2, 1, 1, 1, 1):
        c = rng.standard_normal(dim)
        for _ in range(size):
            out.append((n, (c + 0.25 * rng.standard_normal(dim)) * rng.uniform(0.1, 9)))
            truth.append(len(truth) and 0)
            n += 1
    return [(i, [float(x) for x in v]) for i, v in out]


def cosine_table(data):
    x = np.array([v for _, v in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.round(x @ x.T, 6)


BAD = [(900, None), (901, [0.0] * 48), (902, [float("nan")] * 48), (903, [1.0] * 47), (904, [float("inf")] + [1.0] * 47), (None, [1.0] * 48)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<float>, node string, cell int")


def test_density_sets(spark, rows):
    data = clustered()
    s = cosine_table(data)
    truth = {(int(np.flatnonzero(s[i] >= 0.8)[0]), i) for i in range(len(data)) if np.flatnonzero(s[i] >= 0.8)[0] != i}
    sets, _ = density_clusters.density_sets(frame(spark, data + BAD), dim=48)
    got = rows(sets.where("node <> root").select("root", "node"))
    assert got <= truth and len(got) >= 0.95 * len(truth)
    assert density_clusters.density_sets(frame(spark, []), dim=48)[0].count() == 0


def test_density_counts_all_vectors(spark):
    """Loners and copies count in the cells of the report, and copies have a density of their own."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(48)
    near = [centre + 0.25 * rng.standard_normal(48) for _ in range(4)]
    lone = [centre + 1.2 * rng.standard_normal(48) for _ in range(300)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(near + [near[1]] * 3 + lone)]
    x = np.array([v for _, v in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = [density_clusters._codes.strongest(x, density_clusters.AXES, g)[0] for g in range(density_clusters.TURNS[0])]
    density = np.zeros(len(data), int)
    for grid in itertools.combinations(codes, density_clusters.DEPTH):
        _, cell, n = np.unique(np.stack(grid), axis=1, return_inverse=True, return_counts=True)
        density += np.where(n[cell] >= 2, n[cell], 0)
    got = density_clusters.cluster_report(frame(spark, data + BAD), dim=48, typical=400).collect()
    assert {r["vec_id"] for r in got} >= set(range(7)) and all(r["density"] == density[r["vec_id"]] for r in got)


def test_lone_pairs_near_the_limit(spark, rows):
    rng = np.random.default_rng(8)
    data = []
    for i in range(400):
        u, v = np.linalg.qr(rng.standard_normal((384, 2)))[0].T
        c = 0.801 + 0.02 * (i / 400)
        data += [(2 * i, u.tolist()), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * v).tolist())]
    sets, _ = density_clusters.density_sets(frame(spark, data))
    got = rows(sets.where("node <> root").select("root", "node"))
    print("lone pairs found", len(got))
    assert got <= {(2 * i, 2 * i + 1) for i in range(400)} and len(got) >= 0.6 * 400


def test_vectors_stored_often_are_one_set(spark, rows):
    v = [float(x) for x in np.random.default_rng(3).standard_normal(48)]
    data = [(i, v) for i in range(40)] + [(50, [-x for x in v])]
    sets, _ = density_clusters.density_sets(frame(spark, data), dim=48)
    assert rows(sets.where("node <> root").select("root", "node")) == {(0, i) for i in range(1, 40)}
    near = prefix_forest.neighbours(frame(spark, data), dim=48)
    got = rows(near.select("a", "b"))
    assert {b for a, b in got if a == 39} == {0, 1, 2, 3, 4} and {b for a, b in got if a == 0} == {1, 2, 3, 4, 5} and not any(50 in p for p in got)


def brute_neighbours(data):
    s = cosine_table(data)
    np.fill_diagonal(s, -2)
    order = np.argsort(-s, axis=1, kind="stable")[:, :5]
    return {(i, int(j)) for i in range(len(data)) for j in order[i] if s[i, j] >= 0.8}


@pytest.mark.parametrize("run", [8192, 16])
def test_neighbours_against_brute_force(spark, rows, run):
    data = clustered(1)
    truth = brute_neighbours(data)
    got = rows(prefix_forest.neighbours(frame(spark, data + BAD), dim=48, run=run).select("a", "b"))
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_more_digits_for_more_vectors(spark, rows, monkeypatch):
    assert [prefix_forest.base_depth(n, 8192) for n in (0, 2_000_000, 3_000_000, 10**9)] == [1, 1, 2, 3]
    monkeypatch.setattr(prefix_forest, "base_depth", lambda n, run: 2)
    data = clustered(1)
    for run in (16, 8192):
        got = rows(prefix_forest.neighbours(frame(spark, data), dim=48, run=run).select("a", "b"))
        assert len(got & brute_neighbours(data)) > 0.5 * len(brute_neighbours(data))


@pytest.mark.parametrize("run", [8192, 32])
def test_recall_at_two_digits(spark, rows, run, monkeypatch):
    monkeypatch.setattr(prefix_forest, "base_depth", lambda n, run: 2)
    v = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in v.orderBy("vec_id").collect() if r["embedding"] is not None and len(r["embedding"]) == 384 and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids = [i for i, _ in data]
    truth = {(ids[i], ids[j]) for i, j in brute_neighbours(data)}
    got = rows(prefix_forest.neighbours(v, run=run).select("a", "b"))
    assert len(got & truth) / len(truth) >= 0.9


def test_neighbours_do_not_depend_on_the_number_of_runs(spark, rows):
    """600 vectors of many directions, in runs of 8,192 and of 2 (as if there were 2.4 million)."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((200, 48))
    data = [(i, [float(x) for x in centres[i % 200] + 0.45 * rng.standard_normal(48)]) for i in range(600)]
    one, two = (rows(prefix_forest.neighbours(frame(spark, data), dim=48, run=run).select("a", "b", "place")) for run in (8192, 2))
    assert len(one) > 300 and one == two


@pytest.mark.parametrize("run", [8192, 16])
def test_many_near_copies_are_taken_by_lower_node(spark, rows, run):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(48)
    data = clustered(1) + [(200 + i, [float(x) for x in (v * rng.uniform(0.1, 9)).astype(np.float16)]) for i in range(60)]
    order = [i for i, _ in data]
    truth = {(order[a], order[b]) for a, b in brute_neighbours(data)}
    got = rows(prefix_forest.neighbours(frame(spark, data), dim=48, run=run).select("a", "b"))
    hot = lambda pairs: {p for p in pairs if p[0] >= 200}
    assert hot(got) == hot(truth)


def test_neighbours_of_a_query_set_are_exact(spark, rows):
    data = clustered(2)
    near = prefix_forest.neighbours(frame(spark, data), dim=48, queries="node % 5 = 0", exact=True)
    s = cosine_table(data)
    assert all(abs(s[r["a"], r["b"]] - r["cosine"]) < 1e-9 and r["a"] % 5 == 0 for r in near.collect())


def test_recall_on_the_test_table(spark, rows):
    v = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in v.orderBy("vec_id").collect() if r["embedding"] is not None and len(r["embedding"]) == 384 and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids = [i for i, _ in data]
    truth = {(ids[i], ids[j]) for i, j in brute_neighbours(data)}
    got = rows(prefix_forest.neighbours(v).select("a", "b"))
    assert len(got & truth) / len(truth) >= 0.9


# near-duplicates


def words_of(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 40, n)]


def near_texts(n=120):
    rng = np.random.default_rng(5)
    base = [words_of(s, 30) for s in range(6)]
    out = []
    for i in range(n):
        w = list(base[0 if i % 3 == 0 else i % 6])
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 50)}"
        out.append((i, " ".join(w)))
    return out


def brute_groups(texts, n, t):
    grams = {i: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for i, x in texts if (w := x.lower().split()) and len(w) >= n}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(grams, 2):
        if len(grams[a] & grams[b]) >= t * len(grams[a] | grams[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, find(i)) for i in grams if find(i) != i}


@pytest.mark.parametrize(("n", "t", "long"), [(3, 0.5, 128), (3, 0.5, 4), (5, 0.8, 128), (2, 0.3, 8)])
def test_near_duplicates_against_brute_force(spark, rows, n, t, long, monkeypatch):
    monkeypatch.setattr(sparse_product, "SIDE", 16)
    texts = near_texts()
    odd = [(500, None), (501, ""), (502, "one"), (None, "a b c"), (503, "Same words here"), (504, "same WORDS, here!"), (503, "Same words here")]
    df = spark.createDataFrame([(i, x, 1, "g") for i, x in texts + odd], "ordinal long, text string, size int, grams string")
    truth = brute_groups(texts, n, t) | ({(504, 503)} if n <= 3 else set())
    assert rows(sparse_product.near_duplicates(df, n=n, t=t, long=long).where("node <> root").select("node", "root")) == truth
    assert sparse_product.near_duplicates(df.limit(0), n=n, t=t).count() == 0


def test_few_pairs_of_unrelated_texts_are_moved(spark, rows, monkeypatch):
    texts = [(i, " ".join(f"v{x}" for x in np.random.default_rng(i).integers(0, 60, 80))) for i in range(400)]
    moved, real = [], sparse_product._sized
    monkeypatch.setattr(sparse_product, "_sized", lambda pairs, own: (moved.append(pairs.count()), real(pairs, own))[1])
    df = spark.createDataFrame(texts + [(400, texts[7][1] + " v1 v2 v3")], "ordinal long, text string")
    assert rows(sparse_product.near_duplicates(df, n=3, t=0.5).where("node <> root").select("node", "root")) == {(400, 7)}
    assert 1 <= sum(moved) <= 100


# pieces


@pytest.mark.parametrize("span", [64, 1 << 16])
def test_pieces_cover_the_words_and_overlap(spark, span):
    rng = np.random.default_rng(0)
    ends = [" ", ". ", ", ", "\n", "\n\n", " ", " "]
    texts = {i: "".join(f"word{j}" + ends[int(rng.integers(0, len(ends)))] for j in range(n)) for i, n in enumerate((0, 1, 20, 21, 60, 300))}
    df = spark.createDataFrame([(i, f"p{i}", t, 0) for i, t in texts.items()] + [(50, "p50", None, 0), (None, "n", "a b", 0)], "ordinal long, id string, text string, piece int")
    got = {}
    for r in text_pieces.piece_offsets(df, size=20, overlap=4, span=span).orderBy("node", "piece").collect():
        got.setdefault(r["node"], []).append(r)
    assert set(got) == {1, 2, 3, 4, 5}
    for i, pieces in got.items():
        words = texts[i].split()
        assert all(p["words"] <= 20 and texts[i][p["start"] : p["end"]].split() == words[p["first_word"] : p["first_word"] + p["words"]] for p in pieces)
        assert pieces[-1]["first_word"] + pieces[-1]["words"] == len(words)
        assert all(b["first_word"] == a["first_word"] + a["words"] - 4 for a, b in zip(pieces, pieces[1:]))
    cut = text_pieces.text_pieces(df, size=20, overlap=4).select("source_id").distinct().collect()
    assert {r["source_id"] for r in cut} == {"p3", "p4", "p5"} == {r["source_id"] for r in text_pieces.oversized(df, size=20, overlap=4).collect()}


def test_cuts_at_the_most_natural_boundary():
    text = "a b c d e f g h. i j k l, m n o p"
    starts, ends, strengths = (v.tolist() for v in text_pieces.boundaries(text, "", ""))
    c = text_pieces.Cutter(10, 2)
    pieces = [*c.add(starts, ends, strengths), *c.close()]
    assert text[pieces[0][1] : pieces[0][2]].endswith("h.") and text[pieces[1][1] :].startswith("g h.")
    with pytest.raises(ValueError):
        text_pieces.piece_offsets(None, size=10, overlap=5)
