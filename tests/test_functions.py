import re

import pytest
from pyspark.sql import functions as F

from passagework.functions import text, vector

ODD = ["a @ b", " x ", "", "a b", "x²", "éa", "a\x1cb", "a‍b", "　 日本  語 ", "tab\tnew\nline", "dash-'quote\" (paren)"]


def python_clean(t):
    t = re.sub(r"\s+", " ", t.strip())
    return re.sub(r"[^\w\s.,;:!?'\"-]", "", t)


def test_clean_text_as_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", text.clean_text(F.col("t")).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == {i: python_clean(t) for i, t in enumerate(ODD)}


@pytest.mark.parametrize(("n", "chunks"), [(0, 1), (1, 1), (256, 1), (257, 2), (480, 3), (481, 3)])
def test_chunks(spark, n, chunks):
    t = " ".join(f"w{i}" for i in range(n))
    got = spark.createDataFrame([(t,)], "t string").select(text.chunk_text(F.col("t")).alias("c")).collect()[0]["c"]
    assert len(got) == chunks
    words = got[0].split()
    for c in got[1:]:
        words += c.split()[32:] if len(c.split()) > 32 else []
    assert words == t.split() or chunks == 1


def test_chunk_arguments():
    with pytest.raises(ValueError):
        text.chunk_text(F.col("t"), 10, 10)


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [5.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0]
    assert df.select(vector.normalize(F.col("a"))).collect()[0][0] == [0.0, 0.0]
