"""Services through a fake transport, the retriever, suites, and files of vectors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from passagework.operators import clients, embed, generate, ivf, retrieve, search
from passagework.plans import pipelines, suites
from passagework.sources import tables


class Fake:
    """Answers as a service would; remembers what it was asked."""

    def __init__(self):
        self.asked = []

    def __call__(self, url, headers, body):
        self.asked.append((url, headers, body))
        if url.endswith("/embeddings"):
            rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            return json.dumps({"data": rows[::-1]})
        if body.get("stream"):
            return "\n".join([*(f"data: {json.dumps({'choices': [{'delta': {'content': c}}]})}" for c in ("a", "b")), "data: {\"choices\": []}", ": kept alive", "data: [DONE]"])
        if url.endswith("/messages"):
            return json.dumps({"content": [{"text": "m"}]})
        return json.dumps({"choices": [{"message": {"content": "c"}}]})


def test_services():
    fake = Fake()
    e = clients.ServiceEmbedder(key="k", transport=fake, batch=2)
    x = e.embed_texts(["a", "bb", "ccc"])
    assert x.shape == (3, 2) and np.allclose(x[2], np.array([3, 1]) / np.sqrt(10)) and len(fake.asked) == 2
    assert fake.asked[0][1] == {"Authorization": "Bearer k"} and e.embed_texts([]).shape[0] == 0
    g = clients.ServiceGenerator(key="k", transport=fake, base_url="http://here/v1/", headers={"X-Title": "t"})
    assert g.generate_batch([("q", ["c"])]) == ["c"] and fake.asked[-1][0] == "http://here/v1/chat/completions" and fake.asked[-1][1]["X-Title"] == "t"
    assert fake.asked[-1][2]["messages"][0]["content"] == generate.prompt_text("q", ["c"]) and fake.asked[-1][2]["max_tokens"] == 256
    s = g.generate_stream("q", [])
    assert s["answer"] == "ab" and 0 <= s["ttft_ms"] <= s["total_ms"]
    a = clients.ServiceGenerator("anthropic", key="k", transport=fake)
    assert a.generate_batch([("q", [])]) == ["m"] and "x-api-key" in fake.asked[-1][1]
    with pytest.raises(NotImplementedError):
        a.generate_stream("q", [])


def test_keys_come_from_the_environment(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(KeyError, match="OPENAI_API_KEY"):
        clients.generator_from_environment()
    with pytest.raises(KeyError):
        clients.ServiceEmbedder(transport=Fake()).embed_texts(["a"])
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert clients.generator_from_environment(most=5, transport=Fake()).generate_batch([("q", [])]) == ["c"]
    with pytest.raises(ValueError):
        clients.Service("nobody")


def test_prompt_of_one_question_is_that_of_the_columns(spark):
    contexts = ["x" * 2000, "y" * 2000, "z"]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(contexts)], "g int, rank int, text string")
    block = generate.context_block(["g"], generate.budgeted(rows, ["g"], ["rank"]))
    got = block.select(generate.prompt(F.lit("why?"), F.col("context"))).collect()[0][0]
    assert got == generate.prompt_text("why?", contexts) and got.startswith("Answer the question")


def test_model_is_made_once_a_worker(spark):
    def make():
        return embed.DeterministicEmbedder(8)

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string")
    got = embed.embed(df, clients.WorkerModel("small", make), batch=3).collect()
    assert len(got) == 20 and all(len(r["embedding"]) == 8 for r in got)


def test_retriever(spark):
    e = embed.DeterministicEmbedder(16)
    corpus = search.with_norm(embed.embed(spark.createDataFrame([(i, f"text {i}") for i in range(60)], "vec_id long, text string"), e, "vec_id"))
    for index in (corpus, ivf.build(corpus, 4, 2)):
        r = retrieve.Retriever(index, e, k=3, n_probes=4)
        asked = spark.createDataFrame([(1, "text 7", 0.0), (2, None, 0.0), (None, "text 8", 0.0)], "id long, text string, score double")
        got = r.retrieve_batch(asked).collect()
        best = {x["query_id"]: x["vec_id"] for x in got if x["rank"] == 1}
        assert set(best) == {1, 2} and best[1] == 7 and len(got) == 6
        assert all(abs(x["total_ms"] - x["embed_ms"] - x["search_ms"]) < 1e-6 for x in got)
        assert [x["vec_id"] for x in r.retrieve("text 9", corpus).orderBy("rank").collect()][0] == 9


def test_suites(spark):
    corpus = search.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet")).limit(60).cache()
    asked = corpus.where("id % 20 = 0")
    made, seconds = ivf.build_timed(corpus, 4, iterations=1)
    assert seconds > 0
    assert suites.kernels(asked, corpus, 3, 1).count() == len(search.KERNELS)
    assert suites.searches(asked, corpus, made, [1, 4], 3, 1).where("speedup > 0").count() == 3
    assert suites.ablation(asked, corpus, made, [2], 3).count() == len(search.KERNELS) + 1
    assert {r["name"] for r in suites.builds(corpus, [3], 1).collect()} == {"random", "k-means++"}
    items = spark.createDataFrame([(i, f"q{i}", ["c"]) for i in range(4)], "id long, text string, contexts array<string>")
    g = generate.SimulatedGenerator(5, wait=True)
    assert suites.generations(items, g, [2]).count() == 3
    assert suites.first_tokens(items, g).collect()[0]["share"] == 0.2
    assert suites.embeddings(items, embed.DeterministicEmbedder(4), [2]).count() == 3
    texts = corpus.select("id", F.concat(F.lit("t"), "id").alias("text"))
    queries = asked.join(texts, "id")
    some = suites.combinations(strategies=("arrow",), modes=("sequential",))
    assert suites.end_to_end(queries, corpus, made, texts, some).where("best").count() == 1
    assert suites.overlapped(queries, corpus, made, texts, pipelines.Config("x", "ivf")).count() == 2
    assert len(suites.combinations()) == 9


def test_vectors_of_several_files_have_one_numbering(spark, tmp_path, monkeypatch):
    x = np.arange(70, dtype=np.float64).reshape(35, 2)
    np.save(tmp_path / "a.npy", x[:20])
    np.save(tmp_path / "b.npy", x[20:].astype(np.float32))
    monkeypatch.setattr(tables, "NPY_ROWS", 8)
    got = tables.read_npy(spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(35)) and [r["embedding"] for r in got] == x.tolist()
    np.save(tmp_path / "c.npy", np.zeros(3))
    with pytest.raises(ValueError):
        tables.read_npy(spark, str(tmp_path))


def test_presence_and_build_report(spark, tmp_path):
    folder = tmp_path / "kb"
    spark.range(3).write.parquet(str(folder / "chunks.parquet"))
    got = {r["file"]: (r["present"], r["size"]) for r in tables.presence(spark, str(folder)).collect()}
    assert len(got) == 4 and got["chunks.parquet"][0] and not got["vectors.parquet"][0] and got["vectors.parquet"][1] == "0.0 KB"
    assert tables.presence(spark, str(tmp_path / "nothing")).where("present").count() == 0
    stages = spark.createDataFrame([("chunks", 1.5, 3), ("ivf", 0.5, 3)], "stage string, seconds double, rows long")
    r = tables.write_build_report(stages, str(folder), str(tmp_path / "report")).collect()[0]
    assert r["total_seconds"] == 2.0 and r["seconds"] == {"chunks": 1.5, "ivf": 0.5} and len(r["files"]) >= 1
