"""Every query of the engine by name over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text, vector
from passagework.operators import embed, evaluate, experiments, generate, ivf, kmeans, numbering, search
from passagework.runtime import materialize
from passagework.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = 10
CLUSTERS = 16
PROBES = 4
#: Recall@10 at which the trained index's probes are set; above 0.9 because it is measured on a sample.
TUNED = 0.92


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_norm(table(spark, sf_dir, "embeddings"))


def asking(corpus: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return corpus.where("id % 50 = 0")


def fixed_ivf(spark: SparkSession, sf_dir: str) -> ivf.IVF:
    """An inverted file whose centroids are the first vectors, so that SQL can make it too."""
    corpus = index(spark, sf_dir)
    return ivf.build(corpus, CLUSTERS, iterations=0, start=kmeans.first_rows(corpus, CLUSTERS))


def trained_ivf(spark: SparkSession, sf_dir: str) -> tuple[ivf.IVF, int]:
    """An inverted file with K-Means centroids, and the probes that about 1,000 of its vectors need for ``TUNED``."""
    corpus = index(spark, sf_dir)
    n = corpus.count()
    clusters = spark.range(1).select(text.auto_clusters(F.lit(n)).alias("k")).collect()[0]["k"]
    made = ivf.build(corpus, min(clusters, n))
    made.postings = materialize(made.postings, "postings")
    sample = corpus.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 1000))) == 0)
    return made, ivf.enough_probes(sample, corpus, made, K, TUNED)


W = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> '')"


def sql_stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def sql_clean(x: str) -> str:
    dropped = "[^" + r"\p{L}\p{N}_.,;:!?''\"" + W[1:-1] + "-]"
    return f"regexp_replace(regexp_replace({sql_stripped(x)}, '{W}+', ' ', 'g'), '{dropped}', '', 'g')"


E = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"
COS = "CASE WHEN {a}.n * {b}.n = 0 THEN 0.0 ELSE list_inner_product({a}.v, {b}.v) / ({a}.n * {b}.n) END"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
PAIRS = E + f", s AS (SELECT q.vec_id AS query_id, c.vec_id, round({COS.format(a='q', b='c')}, 6) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0)"
CENTRES = E + f""", c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, v, n FROM (SELECT * FROM e ORDER BY vec_id LIMIT {CLUSTERS})),
r AS (SELECT e.vec_id, c.cluster_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({COS.format(a='e', b='c')}, 12) DESC, c.cluster_id) AS place FROM e CROSS JOIN c),
a AS (SELECT vec_id, cluster_id FROM r WHERE place = 1)"""
IVF_PAIRS = CENTRES + f""", s AS (SELECT q.vec_id AS query_id, t.vec_id, r.place, round({COS.format(a='q', b='t')}, 6) AS score
FROM e q JOIN r ON q.vec_id % 50 = 0 AND r.vec_id = q.vec_id JOIN a ON a.cluster_id = r.cluster_id JOIN e t ON t.vec_id = a.vec_id),
x AS (SELECT q.vec_id AS query_id, t.vec_id, round({COS.format(a='q', b='t')}, 6) AS score FROM e q JOIN e t ON q.vec_id % 50 = 0),
best AS (SELECT query_id, vec_id FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K})"""


# vectors


@query(E + " SELECT vec_id, round(n, 6) AS norm FROM e")
def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select(F.col("id").alias("vec_id"), F.round("norm", 6).alias("norm"))


def _beside_first(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return corpus.join(corpus.where("id = 0").select(F.col("embedding").alias("first"), F.lit(0).alias("zero")), F.col("id") >= F.col("zero"))


@query(E + " SELECT e.vec_id, round(list_inner_product(e.v, f.v), 6) AS dot FROM e JOIN e f ON f.vec_id = 0")
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    return _beside_first(spark, d).select(F.col("id").alias("vec_id"), F.round(vector.dot(F.col("embedding"), F.col("first")), 6).alias("dot"))


@query(E + " SELECT e.vec_id, round(greatest(pow(list_distance(e.v, f.v), 2), 0), 6) AS d2 FROM e JOIN e f ON f.vec_id = 0")
def vec_sq_distance(spark: SparkSession, d: str) -> DataFrame:
    return _beside_first(spark, d).select(F.col("id").alias("vec_id"), F.round(vector.sq_distance(F.col("embedding"), F.col("first")), 6).alias("d2"))


@query(E + " SELECT vec_id, round(CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM e")
def vec_normalize_check(spark: SparkSession, d: str) -> DataFrame:
    unit = vector.normalize(F.col("embedding"))
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x)
    return index(spark, d).select(F.col("id").alias("vec_id"), F.round(vector.l2_norm(unit), 6).alias("norm"), F.round(total, 6).alias("total"))


@query(PAIRS + " SELECT query_id, vec_id, score FROM s")
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return search.scores(asking(corpus), corpus).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(PAIRS + f" SELECT query_id, {RANK} AS rank, vec_id, score FROM s QUALIFY rank <= {K}")
def bruteforce_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return search.exact_topk(asking(corpus), corpus, K)


@query(SQL["bruteforce_topk"])
def bruteforce_topk_expr(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return search.exact_topk(asking(corpus), corpus, K, strategy="expr")


@query(PAIRS + f" SELECT query_id, {RANK} AS rank, vec_id, score FROM s WHERE query_id <> vec_id QUALIFY rank <= {K}")
def bruteforce_topk_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return search.exact_topk(asking(corpus), corpus, K, exclude_self=True)


@query(PAIRS + " SELECT round(max(abs(score - round(CASE WHEN q.n * c.n = 0 THEN 0.0 ELSE list_cosine_similarity(q.v, c.v) END, 6))), 5) AS max_abs_diff, count(*) AS n FROM s JOIN e q ON q.vec_id = s.query_id JOIN e c ON c.vec_id = s.vec_id")
def kernel_max_abs_diff(spark: SparkSession, d: str) -> DataFrame:
    """Column expressions against block products, over all pairs of the query set."""
    corpus = index(spark, d)
    a, b = search.scores(asking(corpus), corpus), search.block_scores(asking(corpus), corpus)
    return experiments.max_abs_diff(a, b, ["query_id", "vec_id"], "score", 5)


_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(PAIRS.replace("vec_id IS NOT NULL AND embedding IS NOT NULL", _USABLE).replace("FROM embeddings", "FROM vectors") + f" SELECT query_id, {RANK} AS rank, vec_id, score FROM s QUALIFY rank <= {K}")
def vectors_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact search over the chunks' embeddings; those of another length or with NaN are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    corpus = search.with_norm(table(spark, d, "vectors").where((F.size("embedding") == 384) & finite))
    return search.exact_topk(asking(corpus), corpus, K)


# clusters


@query(CENTRES + " SELECT vec_id, cluster_id FROM a")
def topk_argmax_cluster(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    near = kmeans.ranked_clusters(corpus, kmeans.first_rows(corpus, CLUSTERS), 1)
    return near.select(F.col("id").alias("vec_id"), "cluster_id")


@query(CENTRES + " SELECT cluster_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS postings FROM a GROUP BY cluster_id")
def ivf_postings(spark: SparkSession, d: str) -> DataFrame:
    """Posting lists as text; a report of a small index."""
    lists = fixed_ivf(spark, d).postings.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return lists.select("cluster_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("postings"))


@query(CENTRES + " SELECT c.cluster_id, count(a.vec_id) AS size FROM c LEFT JOIN a USING (cluster_id) GROUP BY c.cluster_id")
def ivf_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ivf.posting_sizes(fixed_ivf(spark, d))


@query(CENTRES + ", z AS (SELECT count(a.vec_id) AS size FROM c LEFT JOIN a USING (cluster_id) GROUP BY c.cluster_id) SELECT min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size FROM z")
def ivf_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_stats(fixed_ivf(spark, d))


@query(CENTRES + f" SELECT vec_id AS query_id, cluster_id, place AS cluster_rank FROM r WHERE place <= {PROBES} AND vec_id % 50 = 0")
def ivf_probe_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ivf.probes(asking(index(spark, d)), fixed_ivf(spark, d), PROBES).select(F.col("id").alias("query_id"), "cluster_id", "cluster_rank")


@query(IVF_PAIRS + f" SELECT query_id, {RANK} AS rank, vec_id, score FROM s WHERE place <= {PROBES} QUALIFY rank <= {K}")
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    return ivf.search(asking(index(spark, d)), fixed_ivf(spark, d), K, PROBES)


@query()
def ivf_trained_topk(spark: SparkSession, d: str) -> DataFrame:
    """Search over trained centroids with enough probes; the fixed index of ``ivf_topk`` only serves its SQL."""
    made, probes = trained_ivf(spark, d)
    return ivf.search(asking(index(spark, d)), made, K, probes)


_SWEEP = IVF_PAIRS + f""", p AS (SELECT unnest([1, 2, 4, 8, 16]) AS n_probes), f AS (SELECT n_probes, query_id, vec_id FROM s JOIN p ON place <= n_probes
QUALIFY row_number() OVER (PARTITION BY n_probes, query_id ORDER BY score DESC, vec_id) <= {K}),
h AS (SELECT p.n_probes, b.query_id, count(f.vec_id) / count(*) AS recall FROM p CROSS JOIN best b LEFT JOIN f ON f.n_probes = p.n_probes AND f.query_id = b.query_id AND f.vec_id = b.vec_id GROUP BY ALL)"""


@query(_SWEEP + " SELECT n_probes, round(avg(recall), 6) AS recall, count(*) AS queries FROM h GROUP BY n_probes")
def nprobe_sweep(spark: SparkSession, d: str) -> DataFrame:
    corpus, made = index(spark, d), fixed_ivf(spark, d)
    found = ivf.sweep(asking(corpus), made, K, [1, 2, 4, 8, 16])
    return ivf.recall_vs_exact(found, search.exact_topk(asking(corpus), corpus, K), ["n_probes"])


@query(_SWEEP + f" SELECT round(avg(recall), 6) AS recall, count(*) AS queries FROM h WHERE n_probes = {PROBES}")
def ivf_recall_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return ivf.recall_vs_exact(ivf.search(asking(corpus), fixed_ivf(spark, d), K, PROBES), search.exact_topk(asking(corpus), corpus, K))


_STEP = CENTRES + ", m AS (SELECT cluster_id, i - 1 AS dim, avg(v[i]) AS value FROM a JOIN e USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)"


@query(_STEP + " SELECT cluster_id, dim, round(value, 6) AS value FROM m")
def kmeans_step_centroids(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    return kmeans.lloyd_step(corpus, kmeans.first_rows(corpus, CLUSTERS)).select("cluster_id", "dim", F.round("value", 6).alias("value"))


@query(_STEP + " SELECT round(sqrt(sum(pow(value - c.v[dim + 1], 2))), 6) AS shift FROM m JOIN c USING (cluster_id)")
def kmeans_shift(spark: SparkSession, d: str) -> DataFrame:
    corpus = index(spark, d)
    fit = kmeans.fit(corpus, CLUSTERS, iterations=1, start=kmeans.first_rows(corpus, CLUSTERS))
    return spark.createDataFrame([(round(fit.shift, 6),)], "shift double")


def _fit(spark: SparkSession, d: str, init: str) -> DataFrame:
    fit = kmeans.fit(index(spark, d), CLUSTERS, init=init)
    rows = [(i, j, round(float(x), 6)) for i, c in enumerate(fit.centroids) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster_id int, dim int, value double")


@query()
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, "random")


@query()
def kmeans_pp_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, "k-means++")


@query("SELECT n_vectors, CASE WHEN n_vectors <= 10000 THEN 32 WHEN n_vectors <= 100000 THEN 64 WHEN n_vectors <= 500000 THEN 128 ELSE 256 END AS clusters FROM (SELECT count(*) AS n_vectors FROM vectors)")
def auto_cluster_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "vectors").agg(F.count(F.lit(1)).alias("n_vectors"))
    return n.select("n_vectors", text.auto_clusters(F.col("n_vectors")).alias("clusters"))


# texts


@query(f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len({sql_words('text')}) AS words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("words"))


_CHUNKS = f"""WITH t AS (SELECT ordinal, id, {sql_clean('text')} AS text FROM passages WHERE text IS NOT NULL), w AS (SELECT *, {sql_words('text')} AS words FROM t),
c AS (SELECT ordinal, id, 0 AS pos, text FROM w WHERE len(words) <= 256
UNION ALL SELECT ordinal, id, s // 224 AS pos, array_to_string(list_slice(words, s + 1, s + 256), ' ') AS text FROM w, unnest(range(0, len(words), 224)) u(s) WHERE len(words) > 256)"""


@query(_CHUNKS + " SELECT id AS source_id, pos, text FROM c")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    cleaned = table(spark, d, "passages").where("text is not null").select("id", text.clean_text(F.col("text")).alias("text"))
    return cleaned.select(F.col("id").alias("source_id"), F.posexplode(text.chunk_text(F.col("text"))).alias("pos", "text"))


@query(_CHUNKS + " SELECT concat('chunk_', row_number() OVER (ORDER BY ordinal, pos) - 1) AS id, text, id AS source_id FROM c")
def chunk_passages(spark: SparkSession, d: str) -> DataFrame:
    cleaned = table(spark, d, "passages").where("text is not null").select("ordinal", F.col("id").alias("source_id"), text.clean_text(F.col("text")).alias("text"))
    chunks = cleaned.select("ordinal", "source_id", F.posexplode(text.chunk_text(F.col("text"))).alias("pos", "text"))
    return numbering.running_number(chunks, ["ordinal", "pos"]).select(F.concat(F.lit("chunk_"), "n").alias("id"), "text", "source_id")


@query(f"WITH t AS (SELECT ordinal, {sql_stripped('text')} AS text FROM passages), f AS (SELECT text, min(ordinal) AS first FROM t WHERE text <> '' GROUP BY text) SELECT concat('passage_', row_number() OVER (ORDER BY first) - 1) AS id, text FROM f")
def passage_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "passages").select("ordinal", text.strip(F.col("text")).alias("text")).where("text <> ''")
    once = numbering.keep_first(rows, ["text"], ["ordinal"])
    return numbering.running_number(once, ["ordinal"]).select(F.concat(F.lit("passage_"), "n").alias("id"), "text")


_JUDGED = "WITH q AS (SELECT DISTINCT id AS query_id, unnest(relevant_passages) AS text FROM queries), p AS (SELECT text, min(ordinal) AS ordinal FROM passages WHERE text IS NOT NULL GROUP BY text)"


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judged texts of each query, once."""
    return table(spark, d, "queries").where(F.size("relevant_passages") > 0).select(F.col("id").alias("query_id"), F.explode("relevant_passages").alias("text")).distinct()


@query(_JUDGED + " SELECT query_id, ordinal FROM q JOIN p USING (text)")
def query_judgments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where("text is not null").groupBy("text").agg(F.min("ordinal").alias("ordinal"))
    return judgments(spark, d).join(p, "text").select("query_id", "ordinal")


_SOURCES = "WITH c AS (SELECT id, min({'t': text, 's': source_id}) AS r FROM chunks GROUP BY id), s AS (SELECT c.id AS chunk_id, coalesce(p.text, c.r.t) AS text FROM c LEFT JOIN passages p ON p.id = c.r.s)"


@query(_SOURCES + " SELECT chunk_id, text FROM s")
def chunk_to_passage(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.source_texts(table(spark, d, "chunks"), table(spark, d, "passages"))


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT AS seed FROM documents")
def md5_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.md5_seed(F.col("text")).alias("seed"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, (t // 10) || '.' || (t % 10) || unit AS size FROM (SELECT doc_id, CASE WHEN b > 1000000 THEN (b + 50000) // 100000 ELSE (b + 50) // 100 END AS t, CASE WHEN b > 1000000 THEN ' MB' ELSE ' KB' END AS unit FROM (SELECT doc_id, n_chars * 1000 AS b FROM documents))")
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.human_size(F.col("n_chars") * 1000).alias("size"))


@query("SELECT vec_id, (n // 64)::BIGINT AS batch FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM vectors)")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    return numbering.running_number(table(spark, d, "vectors").select("vec_id"), ["vec_id"]).select("vec_id", numbering.batch_number("n", 64).alias("batch"))


@query("SELECT vec_id, (n // ((total + 6) // 7))::BIGINT AS shard FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS total FROM vectors)")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").select("vec_id")
    return numbering.running_number(v, ["vec_id"]).select("vec_id", numbering.shard_number("n", v.count(), 7).alias("shard"))


# prompts and answers

_HITS = "WITH l AS (SELECT DISTINCT ON (log_id) * FROM search_log), h AS (SELECT query_id, lower(regexp_replace(variant, '[\\s\\p{Z}]+', '', 'g')) AS variant, asked_at, hit_rank, chunk_id, score, embed_ms, search_ms FROM l)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the search log, rows delivered twice once, one spelling of variants."""
    log = table(spark, d, "search_log").dropDuplicates(["log_id"])
    return log.withColumn("variant", experiments.canonical_variant(F.col("variant")))


_CONTEXTS = _HITS + """, first AS (SELECT query_id, variant, min(asked_at) AS asked_at FROM h GROUP BY ALL), c AS (SELECT id AS chunk_id, min(text) AS text FROM chunks GROUP BY id),
x AS (SELECT query_id, variant, hit_rank, coalesce(c.text, '') AS text FROM h JOIN first USING (query_id, variant, asked_at) LEFT JOIN c USING (chunk_id)),
b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id, variant ORDER BY hit_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM x),
k AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id, variant ORDER BY hit_rank) AS number, CASE WHEN length(text) > 3000 - before THEN text[1:3000 - before] || '...' ELSE text END AS text FROM b WHERE before < 3000),
g AS (SELECT query_id, variant, string_agg('[Document ' || number || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY number) AS context, count(*) AS documents FROM k GROUP BY ALL),
q AS (SELECT id AS query_id, min(text) AS text FROM queries GROUP BY id)"""


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts within the budget of the first time that each query was asked with each variant."""
    h = hits(spark, d)
    first = h.groupBy("query_id", "variant").agg(F.min("asked_at").alias("asked_at"))
    texts = table(spark, d, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("text").alias("text"))
    x = h.join(first, ["query_id", "variant", "asked_at"]).join(texts, "chunk_id", "left").select("query_id", "variant", "hit_rank", F.coalesce("text", F.lit("")).alias("text"))
    return generate.budgeted(x, ["query_id", "variant"], ["hit_rank"])


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").groupBy(F.col("id").alias("query_id")).agg(F.min("text").alias("question"))
    return generate.context_block(["query_id", "variant"], contexts(spark, d)).join(q, "query_id")


@query(_CONTEXTS + " SELECT query_id, variant, number, text FROM k")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return contexts(spark, d).select("query_id", "variant", "number", "text")


_PROMPT = "'Answer the question based on the provided context. If the context doesn''t contain enough information, say so.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || chr(10) || 'Answer:'"


@query(_CONTEXTS + f" SELECT query_id, variant, {_PROMPT} AS prompt FROM g JOIN q USING (query_id)")
def format_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("query_id", "variant", generate.prompt(F.col("question"), F.col("context")).alias("prompt"))


@query(_CONTEXTS + f" SELECT query_id, variant, trunc(len({sql_words(_PROMPT)}) * 1.3::DOUBLE)::INT AS tokens FROM g JOIN q USING (query_id)")
def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("query_id", "variant", text.prompt_tokens(generate.prompt(F.col("question"), F.col("context"))).alias("tokens"))


@query(_CONTEXTS + " SELECT query_id, variant, 'Simulated answer to ''' || q.text[1:50] || ''' from ' || documents || ' contexts (500 ms)' AS answer FROM g JOIN q USING (query_id)")
def simulated_answer(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("query_id", "variant", generate.simulated_answer(F.col("question"), F.col("documents")).alias("answer"))


@query(SQL["simulated_answer"])
def generated_answer(spark: SparkSession, d: str) -> DataFrame:
    """The same through the pluggable generator, in concurrent batches."""
    g = contexts(spark, d).groupBy("query_id", "variant").agg(F.collect_list("text").alias("contexts"))
    q = table(spark, d, "queries").groupBy(F.col("id").alias("query_id")).agg(F.min("text").alias("text"))
    items = g.join(q, "query_id").withColumn("id", F.to_json(F.struct("query_id", "variant")))
    answers = generate.generate(items, generate.SimulatedGenerator(), mode="threaded")
    key = F.from_json("id", "query_id string, variant string")
    return answers.select(key.alias("k"), "answer").select("k.query_id", "k.variant", "answer")


@query()
def deterministic_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "passages").select("ordinal", "text")
    e = embed.embed(rows, embed.DeterministicEmbedder(), "ordinal", "text", mode="threaded")
    return e.select("ordinal", F.round(vector.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


# evaluation

_RUNS = (
    _HITS
    + ", "
    + _SOURCES[5:]
    + """, t AS (SELECT DISTINCT id AS query_id, unnest(relevant_passages) AS text FROM queries), tt AS (SELECT * FROM t WHERE text IS NOT NULL), n AS (SELECT query_id, count(*) AS wanted FROM tt GROUP BY query_id),
m AS (SELECT h.query_id, h.variant, h.asked_at, h.hit_rank, s.text, tt.text IS NOT NULL AS relevant FROM h LEFT JOIN s USING (chunk_id) LEFT JOIN tt ON tt.query_id = h.query_id AND tt.text = s.text)"""
)


def _each(name: str) -> str:
    v = evaluate.VARIANTS[name]
    cut, mrr = ("AND hit_rank <= 5" if c else "" for c in (v.cut, v.mrr_cut))
    return (
        f"SELECT query_id, variant, asked_at, round(coalesce(any_value(hit) / any_value(wanted), 0.0), 6) AS recall, round(coalesce(1.0 / any_value(first), 0.0), 6) AS rr FROM "
        f"(SELECT query_id, variant, asked_at, count(DISTINCT CASE WHEN relevant {cut} THEN text END) AS hit, min(CASE WHEN relevant {mrr} THEN hit_rank END) AS first FROM m GROUP BY ALL) LEFT JOIN n USING (query_id) "
        + ("WHERE wanted IS NOT NULL " if v.drop_unjudged else "")
        + "GROUP BY query_id, variant, asked_at"
    )


def _judged(spark: SparkSession, d: str, name: str) -> DataFrame:
    source = evaluate.source_texts(table(spark, d, "chunks"), table(spark, d, "passages"))
    seen = hits(spark, d).join(source, "chunk_id", "left").withColumnRenamed("hit_rank", "rank")
    return evaluate.judge(seen, judgments(spark, d), ["query_id", "variant", "asked_at"], 5, name)


@query(_RUNS + " " + _each("V3"))
def recall_mrr_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "V3")


@query(_RUNS + " " + " UNION ALL ".join(f"SELECT '{v}' AS judged, variant, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS n FROM ({_each(v)}) GROUP BY variant" for v in evaluate.VARIANTS))
def evaluation_variants(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for v in evaluate.VARIANTS:
        one = _judged(spark, d, v).groupBy("variant").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("n")).withColumn("judged", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


_LATENCY = "round(avg(x), 6) AS mean_ms, round(stddev_pop(x), 6) AS std_ms, round(median(x), 6) AS median_ms, round(quantile_cont(x, 0.95), 6) AS p95_ms, round(min(x), 6) AS min_ms, count(x) AS n"


@query(_HITS + f", a AS (SELECT DISTINCT query_id, variant, asked_at, embed_ms + search_ms AS x FROM h) SELECT variant, {_LATENCY} FROM a WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY variant")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    asked = hits(spark, d).select("query_id", "variant", "asked_at", "embed_ms", "search_ms").distinct().withColumn("x", F.col("embed_ms") + F.col("search_ms"))
    return evaluate.latency_summary(asked.select("query_id", "variant", "asked_at", "x").distinct(), F.col("x"), ["variant"])


@query(f"WITH a AS (SELECT event_type, value AS x FROM events) SELECT event_type, {_LATENCY} FROM a WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY event_type")
def event_latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(table(spark, d, "events"), F.col("value"), ["event_type"])


@query(
    _RUNS
    + f", e AS ({_each('V3')}), z AS (SELECT variant, round(avg(recall), 6) AS mean_recall, round(avg(rr), 6) AS mean_mrr, count(*) AS num_queries FROM e GROUP BY variant), "
    + f"a AS (SELECT DISTINCT query_id, variant, asked_at, embed_ms + search_ms AS x FROM h), y AS (SELECT variant, {_LATENCY} FROM a WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY variant) SELECT variant, mean_recall, mean_mrr, num_queries, mean_ms, std_ms, p95_ms FROM z LEFT JOIN y USING (variant)"
)
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    q = _judged(spark, d, "V3").groupBy("variant").agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("rr"), 6).alias("mean_mrr"), F.count(F.lit(1)).alias("num_queries"))
    return q.join(latency_summary(spark, d).select("variant", "mean_ms", "std_ms", "p95_ms"), "variant", "left")


# measurements

_METRICS = "WITH r AS (SELECT DISTINCT ON (run_no) dataset, step, section, lower(regexp_replace(variant, '[\\s\\p{Z}]+', '', 'g')) AS variant, metric, metric_value FROM results_bag), m AS (SELECT * FROM r WHERE metric_value IS NOT NULL AND NOT isnan(metric_value))"
_LESS = "metric IN (" + ", ".join(f"'{m}'" for m in experiments.LESS_IS_BETTER) + ")"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return experiments.clean_metrics(table(spark, d, "results_bag"))


@query(_METRICS + ", a AS (SELECT dataset, metric, variant, avg(metric_value) AS value FROM m GROUP BY ALL) SELECT a.dataset, a.metric, a.variant, round(a.value, 6) AS value, round(CASE WHEN a.value <> 0 THEN b.value / a.value END, 6) AS speedup FROM a LEFT JOIN a b ON b.dataset = a.dataset AND b.metric = a.metric AND b.variant = 'bruteforce'")
def speedup_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    a = metrics(spark, d).groupBy("dataset", "metric", "variant").agg(F.avg("metric_value").alias("value"))
    out = experiments.speedup(a, ["dataset", "metric"], F.col("variant") == "bruteforce", "value")
    return out.select("dataset", "metric", "variant", F.round("value", 6).alias("value"), "speedup")


@query(_METRICS + f", a AS (SELECT dataset, metric, variant, avg(metric_value) AS value FROM m GROUP BY ALL) SELECT dataset, metric, variant AS best_variant, round(value, 6) AS best_value FROM a QUALIFY row_number() OVER (PARTITION BY dataset, metric ORDER BY CASE WHEN {_LESS} THEN value ELSE -value END, variant) = 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    a = metrics(spark, d).groupBy("dataset", "metric", "variant").agg(F.avg("metric_value").alias("value"))
    out = experiments.best(a, ["dataset", "metric"], "variant", "value", ~F.col("metric").isin(*experiments.LESS_IS_BETTER))
    return out.select("dataset", "metric", "best_variant", F.round("best_value", 6).alias("best_value"))


@query(
    _METRICS
    + ", a AS (SELECT metric, variant, avg(metric_value) AS a FROM m WHERE step = 'step_0_baseline' GROUP BY ALL), b AS (SELECT metric, variant, avg(metric_value) AS b FROM m WHERE step = 'step_5_threads' GROUP BY ALL) "
    + "SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.variant, b.variant) AS variant, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, round(CASE WHEN a <> 0 THEN (b - a) / abs(a) * 100 END, 4) AS pct, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' WHEN b = a THEN 'same' END AS arrow FROM a FULL JOIN b ON a.metric = b.metric AND a.variant = b.variant"
)
def metric_full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).groupBy("step", "metric", "variant").agg(F.avg("metric_value").alias("value"))
    return experiments.compare(m.where("step = 'step_0_baseline'"), m.where("step = 'step_5_threads'"), ["metric", "variant"], "value")


@query(_METRICS + " SELECT dataset, step, " + ", ".join(f"round(avg(CASE WHEN metric = '{m}' THEN metric_value END), 6) AS {m}" for m in ("recall", "mrr", "mean_ms", "total_ms", "build_ms")) + " FROM m GROUP BY dataset, step")
def key_metrics(spark: SparkSession, d: str) -> DataFrame:
    return experiments.pivot_metrics(metrics(spark, d), ["dataset", "step"], ["recall", "mrr", "mean_ms", "total_ms", "build_ms"], "metric_value")


@query(_METRICS + ", a AS (SELECT e.dataset, e.step, avg(metric_value) AS value FROM experiments e JOIN m ON m.dataset = e.dataset AND m.step = e.step AND m.metric = 'mean_ms' GROUP BY ALL), w AS (SELECT *, lag(value) OVER (PARTITION BY dataset ORDER BY step) AS before FROM a) SELECT dataset, step, round(value, 6) AS value, round(before, 6) AS before, round(value - before, 6) AS change FROM w")
def experiment_progression(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).where("metric = 'mean_ms'").join(table(spark, d, "experiments").select("dataset", "step"), ["dataset", "step"])
    a = m.groupBy("dataset", "step").agg(F.avg("metric_value").alias("value"))
    out = experiments.progression(a, ["dataset"], ["step"], "value")
    return out.select("dataset", "step", F.round("value", 6).alias("value"), F.round("before", 6).alias("before"), "change")


@query("SELECT e.dataset, e.step, e.parent_step, coalesce(e.description, '') AS description, p.step IS NOT NULL AS has_parent, count(r.run_no) AS measurements FROM experiments e LEFT JOIN experiments p ON p.dataset = e.dataset AND p.step = e.parent_step LEFT JOIN (SELECT DISTINCT run_no, dataset, step FROM results_bag) r ON r.dataset = e.dataset AND r.step = e.step GROUP BY ALL")
def experiment_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "experiments")
    parents = e.select("dataset", F.col("step").alias("parent_step"), F.lit(True).alias("has_parent"))
    counts = table(spark, d, "results_bag").select("run_no", "dataset", "step").distinct().groupBy("dataset", "step").agg(F.count("run_no").alias("measurements"))
    out = e.join(parents, ["dataset", "parent_step"], "left").join(counts, ["dataset", "step"], "left")
    return out.select("dataset", "step", "parent_step", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("has_parent", F.lit(False)).alias("has_parent"), F.coalesce("measurements", F.lit(0)).cast("bigint").alias("measurements"))


@query("SELECT event_id, u.key AS name, json_extract_string(props, '$.' || u.key) AS value FROM events, unnest(json_keys(props)) u(key)")
def metrics_flatten_json(spark: SparkSession, d: str) -> DataFrame:
    return experiments.flatten_json(table(spark, d, "events"), ["event_id"], "props")


@query(_METRICS + ", g AS (SELECT variant, unnest(['sequential', 'threaded', 'async']) AS mode FROM (SELECT DISTINCT variant FROM m)) SELECT variant, mode, row_number() OVER (ORDER BY variant, mode) AS config FROM g")
def config_grid(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    modes = spark.createDataFrame([("sequential",), ("threaded",), ("async",)], "mode string")
    grid = experiments.config_grid(metrics(spark, d).select("variant").distinct(), modes)
    return grid.withColumn("config", F.row_number().over(Window.orderBy("variant", "mode")))


@query("WITH x AS (SELECT id, sha256(min(text)) AS digest FROM passages GROUP BY id), y AS (SELECT source_id AS id, sha256(min(text)) AS digest FROM chunks WHERE source_id IS NOT NULL GROUP BY source_id) SELECT x.id, CASE WHEN y.digest IS NULL THEN 'missing' WHEN x.digest = y.digest THEN 'ok' ELSE 'changed' END AS status FROM x LEFT JOIN y USING (id)")
def hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """Digests of passages against those of their chunks: the same only where nothing was cleaned or cut."""
    digest = F.sha2(F.min("text").cast("binary"), 256).alias("digest")
    x = table(spark, d, "passages").groupBy("id").agg(digest)
    y = table(spark, d, "chunks").where("source_id is not null").groupBy(F.col("source_id").alias("id")).agg(digest)
    return experiments.verify_hashes(x, y, "id", "digest")


# stream


@query(SQL["bruteforce_topk"])
def stream_query_feed(spark: SparkSession, d: str) -> DataFrame:
    """The exact search again, with the queries as a stream."""
    corpus = index(spark, d)
    source = table(spark, d, "embeddings")
    arriving = spark.readStream.schema(source.schema).format("parquet").load(f"{d}/embeddings.parquet*").where("vec_id % 50 = 0")
    return feed.exact_feed(search.with_norm(arriving), corpus, K, "exact")


@query(SQL["ivf_topk"])
def stream_ivf_feed(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "embeddings")
    arriving = spark.readStream.schema(source.schema).format("parquet").load(f"{d}/embeddings.parquet*").where("vec_id % 50 = 0")
    return feed.ivf_feed(search.with_norm(arriving), fixed_ivf(spark, d), K, PROBES, "ivf")


@query()
def stream_ivf_trained_feed(spark: SparkSession, d: str) -> DataFrame:
    """The search over trained centroids, with the queries as a stream."""
    source = table(spark, d, "embeddings")
    arriving = spark.readStream.schema(source.schema).format("parquet").load(f"{d}/embeddings.parquet*").where("vec_id % 50 = 0")
    made, probes = trained_ivf(spark, d)
    return feed.ivf_feed(search.with_norm(arriving), made, K, probes, "ivf")
