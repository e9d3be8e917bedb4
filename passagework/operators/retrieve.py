"""From query texts to ranked results with the time of each stage."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import embed, ivf, search
from passagework.runtime import materialize


@dataclass
class Retriever:
    """Embedder and index; ``index`` is an inverted file, or a table made by :func:`search.with_norm` for exact search."""

    index: ivf.IVF | DataFrame
    embedder: embed.Embedder
    k: int = 10
    n_probes: int = 8
    strategy: str = "arrow"

    def find(self, asked: DataFrame) -> DataFrame:
        if isinstance(self.index, ivf.IVF):
            return ivf.search(asked, self.index, self.k, min(self.n_probes, self.index.k))
        return search.exact_topk(asked, self.index, self.k, self.strategy)

    def retrieve_batch(self, queries: DataFrame, key: str = "id", text: str = "text", batch: int = 256) -> DataFrame:
        """``query_id, rank, vec_id, score, embed_ms, search_ms, total_ms``; the time of a batch is split evenly.

        ``key`` is a long; a null text is embedded as the empty one, rows without key are left out.
        """
        rows = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(text).alias("text"))
        began = time.perf_counter()
        asked = materialize(embed.embed(rows, self.embedder, "vec_id", "text", batch), "asked")
        n = max(1, asked.count())
        embedded = time.perf_counter()
        found = materialize(self.find(search.with_norm(asked)), "found")
        ended = time.perf_counter()
        times = ((embedded - began) * 1000 / n, (ended - embedded) * 1000 / n)
        return found.withColumns({"embed_ms": F.lit(times[0]), "search_ms": F.lit(times[1]), "total_ms": F.lit(sum(times))})

    def retrieve(self, query: str, like: DataFrame) -> DataFrame:
        """The same for one query; ``like`` gives the session."""
        return self.retrieve_batch(like.sparkSession.createDataFrame([(0, query)], "id long, text string")).drop("query_id")
