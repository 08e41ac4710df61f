"""What the two classifiers share: the bounded sample of labelled rows, the optimiser, and scoring of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden

#: Labelled rows that a classifier is fitted on, and bytes of a text above which a row isn't sampled: what the driver
#: holds for training stays below their product, whatever the corpus. Scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 4000, 32_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text mod 4 is 2; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_TEXT_BYTES) -> list[tuple[str, int]]:
    """(text, label) of up to ``rows`` labelled documents that aren't held out, those of the smallest id hashes of such as docs have with
    a text of ``most_bytes`` bytes at most.

    Rows that repeat a label count once, and so do rows that repeat a doc_id, by their least text: the driver gets no more than
    ``rows`` texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= most_bytes)
    there = known.distinct().join(texts.select("doc_id"), "doc_id", "left_semi")
    some = there.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["_label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["_label"]))]


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
            self.parameters[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray]) -> tuple[DataFrame, dict[str, str]]:
    """(docs under hidden names with ``_score`` added, those names): score(texts of a batch). A null text counts as an empty one."""
    rows, names = hidden(docs)
    columns = rows.columns
    at = columns.index(names["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score([t or "" for t in batch.column(at).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(found, np.float64), pa.float64()), *batch.columns], names=["_score", *columns])

    schema = ", ".join(["_score double", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)])
    return rows.mapInArrow(run, schema), names


def kept(docs: DataFrame, score: Callable[[list[str]], np.ndarray], condition: str) -> DataFrame:
    """The documents, with all their columns, whose ``_score`` meets the condition."""
    found, names = scored(docs, score)
    return found.where(condition).select(*(F.col(new).alias(old) for old, new in names.items()))


def report(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found, names = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score)
    return found.withColumnRenamed(names["doc_id"], "doc_id").select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
