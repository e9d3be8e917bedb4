import pytest

from compare import connect, same
from conftest import SF
from passagework.plans import bookkeeping, catalog, retrieval  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_kmeans_fit_lowers_the_cost(spark):
    import numpy as np

    from passagework.operators import kmeans, search

    corpus = search.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet"))
    x = np.array([r["embedding"] for r in corpus.orderBy("id").collect()], float)
    start = kmeans.first_rows(corpus, 8)
    fit = kmeans.fit(corpus, 8, iterations=5, start=start)
    c = start.copy()
    for _ in range(5):  # one machine, plain numpy
        a = kmeans.similarities(x, c).argmax(axis=1)
        c = np.array([x[a == k].mean(axis=0) if (a == k).any() else c[k] for k in range(8)])
    assert np.abs(c - fit.centroids).max() < 1e-6
    assert kmeans.similarities(x, fit.centroids).max(axis=1).mean() >= kmeans.similarities(x, start).max(axis=1).mean()


@pytest.mark.parametrize("init", ["random", "k-means++"])
def test_seeds_are_vectors_and_repeatable(spark, init):
    import numpy as np

    from passagework.operators import kmeans, search

    corpus = search.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet"))
    a, b = kmeans.seeds(corpus, 4, 1, init), kmeans.seeds(corpus, 4, 1, init)
    assert np.array_equal(a, b)
    x = np.array([r["embedding"] for r in corpus.collect()], float)
    assert all((np.abs(x - s).max(axis=1) < 1e-9).any() for s in a)


@pytest.mark.parametrize(("name", "sf"), [("ivf_trained_topk", "sf0.01"), ("ivf_trained_topk", "sf0.1"), ("stream_ivf_trained_feed", "sf0.01")])
def test_trained_index_finds_nine_of_ten(spark, name, sf):
    import numpy as np

    folder = f"/root/testdata/{sf}"
    found = {}
    for r in catalog.QUERIES[name](spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    asking = np.flatnonzero(ids % 50 == 0)
    best = ids[np.argsort(-np.round(x[asking] @ x.T, 6), axis=1, kind="stable")[:, :10]]
    recall = np.mean([len(found[ids[a]] & set(b.tolist())) / 10 for a, b in zip(asking, best)])
    print(name, sf, "recall", recall)
    assert recall >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
