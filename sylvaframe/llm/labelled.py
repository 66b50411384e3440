"""Bounded labelled samples, and the byte views of texts that the classifiers share."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents (doc_id, text, label): of the labelled ids among ``docs`` (doc_id, text) that ``train``
    keeps, those with the least hash; of rows that share an id the one whose text has the least hash. Ids labelled twice with different
    values, and null ids or labels, are left out."""
    at_hand = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .join(at_hand, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_other"))
        .where(F.col("label") == F.col("_other"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    rows = docs.join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def fitted(examples: DataFrame, fit) -> dict[str, np.ndarray]:
    """Fit a model on a bounded set of examples in one task and return its arrays.

    The features are made where the rows lie; only those of the bounded sample meet in the task.

    ``fit`` takes the examples as one Arrow table, sorted by ``doc_id``, and returns named arrays of a size
    that the model fixes.
    """

    def run(batches):
        rows = pa.Table.from_batches(list(batches))
        out = io.BytesIO()
        np.savez(out, **fit(rows.sort_by("doc_id") if rows.num_rows else rows))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    schema = examples.schema

    def whole(batches):  # an empty input still gives a model
        from pyspark.sql.pandas.types import to_arrow_schema

        got = list(batches) or [pa.RecordBatch.from_pylist([], schema=to_arrow_schema(schema))]
        yield from run(got)

    with np.load(io.BytesIO(examples.repartition(1).mapInArrow(whole, "model binary").head().model)) as model:
        return {k: model[k] for k in model.files}


#: A-Z to a-z; all other ASCII that is no letter to a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def joined(texts: list[bytes], gap: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with ``gap`` spaces before each and after the last; where each begins and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + gap) - sizes
    pad = b" " * gap
    return np.frombuffer(pad + pad.join(texts) + pad, np.uint8), first, first + sizes


def text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()
