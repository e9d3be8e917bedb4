"""Prompts within a budget of context, and generation as a pluggable batched function."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import prompt_tokens
from passagework.operators.embed import concurrent_batches
from passagework.runtime import ship

MAX_CONTEXT = 3000
#: Parts of a prompt.
INSTRUCTION = "Answer the question based on the provided context. If the context doesn't contain enough information, say so.\n\n"
SEPARATOR = "\n\n---\n\n"
MARK = "..."


class Generator(Protocol):
    """Anything that answers a list of (query, contexts)."""

    def generate_batch(self, items: list[tuple[str, list[str]]]) -> list[str]: ...


class SimulatedGenerator:
    """Answers that depend on the query and the number of contexts only, after an optional wait."""

    def __init__(self, latency_ms: int = 500, wait: bool = False):
        self.latency_ms, self.wait = latency_ms, wait

    def generate_batch(self, items: list[tuple[str, list[str]]]) -> list[str]:
        if self.wait:
            time.sleep(self.latency_ms / 1000)
        return [f"Simulated answer to '{q[:50]}' from {len(c)} contexts ({self.latency_ms} ms)" for q, c in items]

    def generate_stream(self, query: str, contexts: list[str]) -> dict:
        """Answer with the time to its first token: a fifth of the latency, then the rest."""
        return {"answer": f"Simulated answer to '{query[:40]}'", "ttft_ms": self.latency_ms * 0.2, "total_ms": float(self.latency_ms)}


def budgeted(contexts: DataFrame, group: list[str], order: list[str], text: str = "text", most: int = MAX_CONTEXT) -> DataFrame:
    """Contexts within a budget of characters: the one that crosses it is cut and marked, the rest dropped."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(F.char_length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = contexts.withColumn("_before", before).where(F.col("_before") < most)
    room = F.lit(most) - F.col("_before")
    cut = F.when(F.char_length(text) > room, F.concat(F.substring(F.col(text), F.lit(1), room.cast("int")), F.lit(MARK))).otherwise(F.col(text))
    return kept.withColumn(text, cut).withColumn("number", F.row_number().over(w)).drop("_before")


def context_block(group: list[str], contexts: DataFrame, text: str = "text") -> DataFrame:
    """``*group, context``: the numbered documents of each group in order, joined by separators."""
    numbered = F.struct("number", F.concat(F.lit("[Document "), F.col("number").cast("string"), F.lit("]\n"), F.col(text)).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(numbered)), lambda x: x["part"])
    return contexts.groupBy(*group).agg(F.array_join(parts, SEPARATOR).alias("context"), F.count(F.lit(1)).alias("documents"))


def prompt(question: Column, context: Column) -> Column:
    """The whole prompt: instruction, context and question."""
    return F.concat(F.lit(INSTRUCTION + "Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def prompt_text(question: str, contexts: list[str], most: int = MAX_CONTEXT) -> str:
    """The same for one question, with its contexts cut to the budget and numbered."""
    parts, used = [], 0
    for c in contexts:
        if used >= most:
            break
        room = most - used
        parts.append(f"[Document {len(parts) + 1}]\n" + (c if len(c) <= room else c[:room] + MARK))
        used += len(c)
    return f"{INSTRUCTION}Context:\n{SEPARATOR.join(parts)}\n\nQuestion: {question}\n\nAnswer:"


def simulated_answer(question: Column, documents: Column, latency_ms: int = 500) -> Column:
    return F.concat(F.lit("Simulated answer to '"), F.substring(question, 1, 50), F.lit("' from "), documents.cast("string"), F.lit(f" contexts ({latency_ms} ms)"))


def numbered(items: DataFrame) -> DataFrame:
    """``contexts`` as they stand in a prompt: each under its number."""
    headed = F.transform("contexts", lambda c, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), c))
    return items.withColumn("contexts", headed)


def generate_streams(items: DataFrame, generator, key: str = "id") -> DataFrame:
    """``key, answer, ttft_ms, total_ms, prompt_tokens`` of items (key, text, contexts array<string>).

    The generator's ``generate_stream`` gives each answer with the time to its first token.  A null
    text or null contexts count as empty.
    """
    ship(items.sparkSession)
    rows = items.select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    rows = rows.withColumn("prompt_tokens", prompt_tokens(prompt(F.col("text"), F.array_join("contexts", SEPARATOR))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [generator.generate_stream(q, c) for q, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([o["answer"] for o in out], pa.string()), *[pa.array([o[n] for o in out], pa.float64()) for n in ("ttft_ms", "total_ms")]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(3)], [key, "answer", "ttft_ms", "total_ms", "prompt_tokens"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, answer string, ttft_ms double, total_ms double, prompt_tokens int")


def generate(items: DataFrame, generator: Generator, key: str = "id", batch: int = 16, mode: str = "sequential", workers: int = 8) -> DataFrame:
    """``key, answer, prompt_tokens`` of items (key, text, contexts array<string>)."""
    if mode not in ("sequential", "threaded", "async"):
        raise ValueError(f"unknown mode {mode!r}")
    ship(items.sparkSession)
    rows = items.select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    rows = rows.withColumn("prompt_tokens", prompt_tokens(prompt(F.col("text"), F.array_join("contexts", SEPARATOR))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            parts = concurrent_batches(generator.generate_batch, [pairs[i : i + batch] for i in range(0, len(pairs), batch)], mode, workers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for p in parts for a in p], pa.string()), b.column(3)], [key, "answer", "prompt_tokens"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, answer string, prompt_tokens int")
