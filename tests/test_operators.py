import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from passagework.operators import embed, evaluate, experiments, generate, ivf, kmeans, numbering, search


def vectors(spark, rows):
    return search.with_norm(spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm string"))


def test_topk_ties_zero_vectors_and_small_tables(spark, rows):
    v = vectors(spark, [(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], None), (3, [0.0, 0.0], None), (None, [1.0, 1.0], None), (4, None, None)])
    for strategy in ("arrow", "expr"):
        got = rows(search.exact_topk(v.where("id = 1"), v, 10, strategy))
        assert got == {(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0)}
    with pytest.raises(ValueError):
        search.exact_topk(v, v, 0)
    assert search.exact_topk(v, v.where("id = 9"), 3).count() == 0


def test_all_probes_are_exact_and_saved_index_prunes(spark, rows, tmp_path):
    corpus = search.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet"))
    q = corpus.where("id % 50 = 0")
    made = ivf.build(corpus, 8, iterations=2)
    exact = rows(search.exact_topk(q, corpus, 5))
    assert rows(ivf.search(q, made, 5, 8)) == exact
    ivf.save(made, str(tmp_path / "index"))
    again = ivf.load(spark, str(tmp_path / "index"))
    assert rows(ivf.search(q, again, 5, 8)) == exact
    plan = again.postings.where("cluster_id in (0, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster_id" in plan
    recalls = [r["recall"] for r in ivf.recall_vs_exact(ivf.sweep(q, made, 5, [1, 2, 4, 8]), search.exact_topk(q, corpus, 5), ["n_probes"]).orderBy("n_probes").collect()]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    with pytest.raises(ValueError):
        ivf.search(q, made, 5, 9)


def test_topk_keeps_few_rows_before_the_shuffle(spark):
    corpus = search.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet"))
    plan = search.exact_topk(corpus.where("id % 50 = 0"), corpus, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_running_numbers_and_first_rows(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, v int")
    n = numbering.running_number(df, ["v"]).orderBy("v").collect()
    assert [r["n"] for r in n] == list(range(100))
    first = numbering.keep_first(df, ["k"], ["v"]).orderBy("k").collect()
    assert [r["v"] for r in first] == list(range(7))


def test_download(spark):
    from passagework.schema import SOURCE_ITEM

    schema = "item long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SOURCE_ITEM.fields)
    items = spark.createDataFrame([(0, ([" a ", "b"], [1, 0]), "q0", None), (1, (["a", ""], [0, 1]), "q1", "t"), (2, (["c", "b"], [1, 1]), "q2", "t")], schema)
    p, q = numbering.download(items)
    assert [(r["id"], r["text"]) for r in p.orderBy("ordinal").collect()] == [("passage_0", "a"), ("passage_1", "b"), ("passage_2", "c")]
    assert [(r["id"], r["text"], r["query_type"], r["relevant_passages"]) for r in q.orderBy("ordinal").collect()] == [("query_0", "q0", "", ["a"]), ("query_1", "q2", "t", ["c", "b"])]


def test_recall_and_reciprocal_rank(spark):
    hits = spark.createDataFrame([("q", i + 1, f"doc_{d}") for i, d in enumerate([3, 7, 1, 5, 9])] + [("none", 1, "doc_1")], "query_id string, rank int, text string")
    truth = spark.createDataFrame([("q", "doc_1"), ("q", "doc_5"), ("q", "doc_5")], "query_id string, text string")
    at5 = {r["query_id"]: r for r in evaluate.judge(hits, truth, ["query_id"], 5).collect()}
    assert at5["q"]["recall"] == 1.0 and at5["q"]["rr"] == round(1 / 3, 6) and at5["none"]["recall"] == 0.0
    at3 = {r["query_id"]: r for r in evaluate.judge(hits, truth, ["query_id"], 3).collect()}
    assert at3["q"]["recall"] == 0.5
    assert evaluate.judge(hits, truth, ["query_id"], 3, "V4").count() == 1


def test_context_budget(spark):
    cases = {"under": [10, 20], "exact": [1000, 2000], "over": [2000, 1500, 5]}
    df = spark.createDataFrame([(k, i, "x" * n) for k, v in cases.items() for i, n in enumerate(v)], "g string, i int, text string")
    got = generate.budgeted(df, ["g"], ["i"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("number", F.char_length("text").alias("n")))).alias("a"))
    assert {r["g"]: [x["n"] for x in r["a"]] for r in got.collect()} == {"under": [10, 20], "exact": [1000, 2000], "over": [2000, 1003]}


def test_embedding_is_the_same_in_every_mode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "a"])], "id int, text string")
    out = {}
    for mode in ("sequential", "threaded", "async"):
        out[mode] = {r["id"]: r["embedding"] for r in embed.embed(df, embed.DeterministicEmbedder(16), batch=2, mode=mode).collect()}
    assert out["sequential"] == out["threaded"] == out["async"]
    assert out["async"][0] == out["async"][3]
    v = np.random.RandomState(int(hashlib.md5(b"a").hexdigest()[:8], 16)).randn(16).astype(np.float32)
    assert np.allclose(out["async"][0], v / np.linalg.norm(v))


def test_comparison_with_missing_sides(spark, rows):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("y", 3.0), ("z", 1.0)], "metric string, value double")
    assert rows(experiments.compare(a, b, ["metric"], "value")) == {("x", 1.0, None, None, None, None), ("y", 2.0, 3.0, 1.0, 50.0, "up"), ("z", None, 1.0, None, None, None)}


def test_sources(spark, tmp_path):
    from passagework.schema import PASSAGE
    from passagework.sources import tables

    (tmp_path / "p.jsonl").write_text('{"id": "passage_0", "text": "é"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "p.jsonl"), PASSAGE).collect()[0]["text"] == "é"
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["embedding"] for r in tables.read_npy(spark, str(tmp_path / "v.npy")).orderBy("vec_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    expected = tables.manifest(spark, str(tmp_path)).union(spark.createDataFrame([("gone", "0", 1)], "file string, sha string, size bigint"))
    status = {r["file"]: r["status"] for r in tables.verify(spark, str(tmp_path), expected).collect()}
    assert status == {"p.jsonl": "ok", "v.npy": "ok", "gone": "missing"}
    with pytest.raises(FileNotFoundError):
        tables.load_knowledge_base(spark, str(tmp_path))


def test_dead_centroid_moves(spark):
    v = vectors(spark, [(i, [1.0, float(i) / 10], None) for i in range(5)])
    fit = kmeans.fit(v, 2, iterations=3, start=np.array([[1.0, 0.1], [-1.0, 0.0]]))
    assert np.isfinite(fit.centroids).all() and (fit.centroids[:, 0] > 0).all()


def test_pipeline_from_passages_to_answers(spark, tmp_path):
    from passagework.plans import pipelines

    p = spark.read.parquet(f"{SF}/passages.parquet")
    path = str(tmp_path / "kb")
    stages = {r["stage"]: r["rows"] for r in pipelines.build_knowledge_base(p, path, embed.DeterministicEmbedder(32), clusters=4, iterations=2).collect()}
    assert stages["chunks"] == stages["vectors"] == stages["ivf"]
    index = ivf.load(spark, f"{path}/ivf")
    corpus = search.with_norm(spark.read.parquet(f"{path}/vectors.parquet"))
    texts = spark.read.parquet(f"{path}/chunks.parquet").select(F.col("ordinal").alias("id"), "text")
    q = corpus.where("id < 6").join(texts, "id")
    for c in (pipelines.CONFIGS[1], pipelines.CONFIGS[3]):
        got = pipelines.answer(q, corpus, index, texts, c).collect()
        assert len(got) == 6 and all("from 3 contexts" in r["answer"] for r in got)
    compared = pipelines.compare(q, corpus, index, texts, pipelines.CONFIGS[:2]).collect()
    assert compared[0]["speedup"] == 1.0 and len(compared) == 2
    with pytest.raises(ValueError):
        pipelines.Config("x", index="hnsw")


def test_cached_embeddings_presets_and_judged_queries(spark, tmp_path, rows):
    from passagework.sources import tables

    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    first = {r["id"]: r["embedding"] for r in embed.embed_cached(df, embed.DeterministicEmbedder(8), path).collect()}
    again = {r["id"]: r["embedding"] for r in embed.embed_cached(df.where("id < 4"), embed.DeterministicEmbedder(8), path).collect()}
    assert first[1] == first[3] == again[1] and set(first) == {1, 2, 3, 4} and spark.read.parquet(path).count() == 3
    assert tables.sizes("small", queries=7) == (5_000, 7)
    with pytest.raises(ValueError):
        tables.sizes("huge")
    q = spark.read.parquet(f"{SF}/queries.parquet")
    assert evaluate.judged_queries(q).where("relevant_passages is null or size(relevant_passages) = 0").count() == 0
    assert evaluate.judged_queries(q, 3).count() == 3
    x = spark.createDataFrame([("m", 4.0), ("n", 1.0)], "metric string, value double")
    y = spark.createDataFrame([("m", 2.0), ("n", 0.0)], "metric string, value double")
    assert rows(evaluate.improvement(x, y, "metric", "value")) == {("m", 4.0, 2.0, 2.0), ("n", 1.0, 0.0, float("inf"))}
    kb = tables.load_knowledge_base(spark, SF)
    assert tables.check_knowledge_base(kb).collect()[0]["chunks"] > 0


def test_json_stream(spark, tmp_path):
    from passagework.schema import PASSAGE
    from passagework.sources import tables

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text('{"id": "passage_%d", "text": "t"}\n' % i)
    s = tables.stream_jsonl(spark, str(tmp_path / "in"), PASSAGE).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    s.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_exact_search_broadcasts_no_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(5000)]
    corpus = search.with_norm(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    found = search.exact_topk(corpus.where("id % 500 = 0"), corpus, 3)
    x = np.array([v for _, v in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()} == {(q, k + 1, int(j)) for q in range(0, 5000, 500) for k, j in enumerate(np.argsort(-s[q], kind="stable")[:3])}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
