"""Schemas of the project's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType | type[T.DataType]) -> T.StructType:
    """A schema that can be made before there is a session."""
    return T.StructType([T.StructField(n, t() if isinstance(t, type) else t) for n, t in fields.items()])


S, L, I, D = T.StringType, T.LongType, T.IntegerType, T.DoubleType  # noqa: E741
TEXTS = T.ArrayType(S())

SOURCE_ITEM = _struct(passages=_struct(passage_text=TEXTS, is_selected=T.ArrayType(I())), query=S, query_type=S)
PASSAGE = _struct(id=S, text=S)
QUERY = _struct(id=S, text=S, query_type=S, relevant_passages=TEXTS)
CHUNK = _struct(id=S, text=S, source_id=S)
VECTOR = _struct(vec_id=L, embedding=T.ArrayType(T.FloatType()))
METRIC = _struct(dataset=S, step=S, section=S, variant=S, metric=S, value=D)
EXPERIMENT = _struct(dataset=S, step=S, parent_step=S, description=S, saved_at=T.TimestampType)
MANIFEST = _struct(file=S, sha256=S, size_bytes=L)
BENCHMARK = _struct(name=S, component=S, n_vectors=L, dimension=I, times_ms=T.ArrayType(D()))
