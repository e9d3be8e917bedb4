"""Retrieval over judged queries, streamed answers and kernels: queries of the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import evaluate, generate, ivf, kmeans, search
from passagework.plans import catalog
from passagework.plans.catalog import _CONTEXTS, _HITS, CLUSTERS, COS, E, K, SQL, hits, judgments, query, sql_words, table

# judged queries

_ASKED = f"""WITH e AS (SELECT vec_id, chunk_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM vectors WHERE vec_id IS NOT NULL AND {catalog._USABLE}),
p AS (SELECT text, min(ordinal) AS ordinal FROM passages WHERE text IS NOT NULL GROUP BY text), t AS (SELECT DISTINCT id AS query_id, unnest(relevant_passages) AS text FROM queries), tt AS (SELECT * FROM t WHERE text IS NOT NULL),
wanted AS (SELECT query_id, count(*) AS wanted FROM tt GROUP BY query_id), lowest AS (SELECT query_id, min(ordinal) AS ordinal FROM tt JOIN p USING (text) GROUP BY query_id),
asked AS (SELECT l.query_id, min(e.vec_id) AS asked FROM lowest l JOIN passages s USING (ordinal) JOIN chunks c ON c.source_id = s.id JOIN e ON e.chunk_id = c.id GROUP BY l.query_id),
o AS (SELECT id, min({{'t': text, 's': source_id}}) AS r FROM chunks GROUP BY id), src AS (SELECT o.id AS chunk_id, coalesce(s.text, o.r.t) AS text FROM o LEFT JOIN passages s ON s.id = o.r.s),
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, v, n FROM (SELECT * FROM e ORDER BY vec_id LIMIT {CLUSTERS})),
r AS (SELECT e.vec_id, c.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({COS.format(a='e', b='c')}, 12) DESC, c.cluster_id) AS place FROM e CROSS JOIN c),
a AS (SELECT vec_id, cluster_id FROM r WHERE place = 1),
s AS (SELECT asked.query_id, x.vec_id, x.chunk_id, coalesce(r.place, 0) AS place, round({COS.format(a='q', b='x')}, 6) AS score FROM asked JOIN e q ON q.vec_id = asked.asked CROSS JOIN e x JOIN a ON a.vec_id = x.vec_id LEFT JOIN r ON r.vec_id = q.vec_id AND r.cluster_id = a.cluster_id),
settings AS (SELECT unnest([0, 1, 2, 4, 8, 16]) AS n_probes),
h AS (SELECT n_probes, query_id, chunk_id, row_number() OVER (PARTITION BY n_probes, query_id ORDER BY score DESC, vec_id) AS rank FROM s JOIN settings ON n_probes = 0 OR place <= n_probes QUALIFY rank <= {K}),
m AS (SELECT h.n_probes, h.query_id, h.rank, src.text, tt.text IS NOT NULL AS relevant FROM h LEFT JOIN src USING (chunk_id) LEFT JOIN tt ON tt.query_id = h.query_id AND tt.text = src.text),
j AS (SELECT n_probes, query_id, round(coalesce(count(DISTINCT CASE WHEN relevant THEN m.text END) / any_value(wanted), 0.0), 6) AS recall, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0.0), 6) AS rr FROM m LEFT JOIN wanted USING (query_id) GROUP BY n_probes, query_id)"""


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunk embeddings that can be searched: (id, embedding, norm, chunk_id)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = table(spark, d, "vectors").where((F.size("embedding") == 384) & finite)
    return search.with_norm(good).join(good.select(F.col("vec_id").alias("id"), "chunk_id"), "id")


def judged_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, asked``: a judged query asks with the first vector of its first relevant passage."""
    p = table(spark, d, "passages").where("text is not null").groupBy("text").agg(F.min("ordinal").alias("ordinal"))
    low = judgments(spark, d).join(p, "text").groupBy("query_id").agg(F.min("ordinal").alias("ordinal"))
    source = low.join(table(spark, d, "passages").select("ordinal", F.col("id").alias("source_id")), "ordinal")
    chunk = source.join(table(spark, d, "chunks").select("source_id", F.col("id").alias("chunk_id")), "source_id")
    return chunk.join(usable_vectors(spark, d).select("chunk_id", "id"), "chunk_id").groupBy("query_id").agg(F.min("id").alias("asked"))


def _judged(spark: SparkSession, d: str, found: DataFrame, by: list[str]) -> DataFrame:
    """Recall and reciprocal rank of results (asked vector, rank, vec_id) for each judged query."""
    corpus = usable_vectors(spark, d)
    seen = found.withColumnRenamed("query_id", "asked").join(judged_vectors(spark, d), "asked").join(corpus.select(F.col("id").alias("vec_id"), "chunk_id"), "vec_id")
    texts = evaluate.source_texts(table(spark, d, "chunks"), table(spark, d, "passages"))
    return evaluate.judge(seen.join(texts, "chunk_id", "left"), judgments(spark, d), ["query_id", *by], K, "V3")


def _asking(spark: SparkSession, d: str) -> DataFrame:
    asked = judged_vectors(spark, d).select(F.col("asked").alias("id")).distinct()
    return usable_vectors(spark, d).join(asked, "id", "left_semi").select("id", "embedding", "norm")


def _index(spark: SparkSession, d: str) -> ivf.IVF:
    corpus = usable_vectors(spark, d).select("id", "embedding", "norm")
    return ivf.build(corpus, CLUSTERS, iterations=0, start=kmeans.first_rows(corpus, CLUSTERS))


@query(_ASKED + " SELECT query_id, recall, rr FROM j WHERE n_probes = 0")
def judged_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Exact search for every judged query, with its recall and reciprocal rank."""
    found = search.exact_topk(_asking(spark, d), usable_vectors(spark, d).select("id", "embedding", "norm"), K)
    return _judged(spark, d, found, [])


@query(_ASKED + " SELECT query_id, recall, rr FROM j WHERE n_probes = 8")
def judged_retrieval_ivf(spark: SparkSession, d: str) -> DataFrame:
    """The same through an inverted file."""
    return _judged(spark, d, ivf.search(_asking(spark, d), _index(spark, d), K, 8), [])


@query(_ASKED + " SELECT n_probes, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS queries FROM j WHERE n_probes > 0 GROUP BY n_probes")
def judged_probe_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Quality on judged queries for several numbers of probes, all from one search."""
    each = _judged(spark, d, ivf.sweep(_asking(spark, d), _index(spark, d), K, [1, 2, 4, 8, 16]), ["n_probes"])
    return each.groupBy("n_probes").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


# kernels


@query("WITH k AS (SELECT unnest(" + str(sorted(search.KERNELS)) + ") AS kernel), b AS (" + SQL["bruteforce_topk"] + ") SELECT kernel, query_id, rank, vec_id, score FROM k CROSS JOIN b")
def kernel_topk(spark: SparkSession, d: str) -> DataFrame:
    """The exact search by every kernel."""
    corpus = catalog.index(spark, d)
    out = None
    for name in sorted(search.KERNELS):
        one = search.by_kernel(name, catalog.asking(corpus), corpus, K).withColumn("kernel", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# answers as streams of tokens

_STREAM = _CONTEXTS + f", z AS (SELECT query_id, variant, 'Simulated answer to ''' || q.text[1:40] || '''' AS answer, 100.0::DOUBLE AS ttft_ms, 500.0::DOUBLE AS total_ms, trunc(len({sql_words(catalog._PROMPT)}) * 1.3::DOUBLE)::INT AS prompt_tokens FROM g JOIN q USING (query_id))"


@query(_STREAM + " SELECT query_id, variant, answer, ttft_ms, total_ms, prompt_tokens FROM z")
def streamed_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers that come token by token, with the time to the first one."""
    g = catalog.contexts(spark, d).groupBy("query_id", "variant").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]).alias("contexts"))
    q = table(spark, d, "queries").groupBy(F.col("id").alias("query_id")).agg(F.min("text").alias("text"))
    items = generate.numbered(g.join(q, "query_id")).withColumn("id", F.to_json(F.struct("query_id", "variant")))
    out = generate.generate_streams(items, generate.SimulatedGenerator())
    key = F.from_json("id", "query_id string, variant string")
    return out.select(key.alias("k"), "answer", "ttft_ms", "total_ms", "prompt_tokens").select("k.*", "answer", "ttft_ms", "total_ms", "prompt_tokens")


@query(_STREAM + " SELECT variant, round(avg(ttft_ms), 6) AS mean_ttft_ms, round(quantile_cont(ttft_ms, 0.95), 6) AS p95_ttft_ms, round(avg(total_ms), 6) AS mean_total_ms, count(*) AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM z GROUP BY variant")
def first_token_summary(spark: SparkSession, d: str) -> DataFrame:
    return streamed_answer(spark, d).groupBy("variant").agg(
        F.round(F.avg("ttft_ms"), 6).alias("mean_ttft_ms"), F.round(F.percentile("ttft_ms", F.lit(0.95)), 6).alias("p95_ttft_ms"), F.round(F.avg("total_ms"), 6).alias("mean_total_ms"),
        F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"),
    )


@query(_HITS + ", a AS (SELECT DISTINCT query_id, variant, asked_at, embed_ms, search_ms FROM h) SELECT variant, count(*) AS total_requests, count(embed_ms) AS embeddings, round(sum(embed_ms), 4) AS embed_ms, round(sum(search_ms), 4) AS search_ms FROM a GROUP BY variant")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    """Requests and summed latency of each variant; aggregated columns take the place of shared counters."""
    asked = hits(spark, d).select("query_id", "variant", "asked_at", "embed_ms", "search_ms").distinct()
    return asked.groupBy("variant").agg(F.count(F.lit(1)).alias("total_requests"), F.count("embed_ms").alias("embeddings"), F.round(F.sum("embed_ms"), 4).alias("embed_ms"), F.round(F.sum("search_ms"), 4).alias("search_ms"))


@query(E + " SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, round(n, 6) AS norm FROM e ORDER BY vec_id LIMIT 500")
def corpus_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 vectors, as small benchmarks use them; the cut is the operator."""
    from passagework.operators.numbering import running_number

    first = catalog.index(spark, d).orderBy("id").limit(500)
    return running_number(first, ["id"], "place").select(F.col("id").alias("vec_id"), "place", F.round("norm", 6).alias("norm"))
