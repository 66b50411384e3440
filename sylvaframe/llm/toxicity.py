"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z) and read as UTF-8 bytes with every ASCII byte that is no letter as a space.
Its features are the distinct 4- and 5-grams of these bytes, hashed to ``BUCKETS`` values. On the
labelled sample each feature gets the log of the ratio of its (smoothed) frequencies in both classes; a
logistic regression, in which both classes weigh the same, is fitted on the features times their ratios, and the product of
weight and ratio is all that scoring needs.

The fit uses at most ``MAX_ROWS`` labelled documents (those with the least hash of the id) in one task;
scoring covers every row where it lies, without a shuffle. Labels, language, source and id are no inputs.
Null and empty texts get the score of a text without features. Without labels, or with one class only,
every score is the share of that class (0 without labels). Equal or null ids are scored row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, text_chunks
from .labelled import LETTERS, fitted, joined, labelled_sample, text_bytes

BITS = 20
BUCKETS = 1 << BITS
MAX_ROWS = 8000
LEAST_DOCUMENTS = 4  # of the sample in which a feature must stand
_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in order of place, with the text of each (repeats included)."""
    raw, first, last = joined(texts)
    owner = np.repeat(np.arange(len(texts)), last - first + 6)  # a text and the gap before it
    n = len(owner)
    b = LETTERS[raw].astype(np.uint32)
    four = b[:n] | (b[1 : n + 1] << np.uint32(8)) | (b[2 : n + 2] << np.uint32(16)) | (b[3 : n + 3] << np.uint32(24))
    at = np.flatnonzero(four != np.uint32(0x20202020))
    mixed = four[at] * _A
    h4 = mixed >> np.uint32(32 - BITS)
    h5 = ((mixed ^ (b[at + 4] * _B)) * _A) >> np.uint32(32 - BITS)
    return np.concatenate([h4, h5]), np.tile(owner[at], 2)


def _features(batch):
    h, owner = ngrams(text_bytes(batch))
    seen = np.unique((owner.astype(np.int64) << BITS) | h)
    counts = np.bincount(seen >> BITS, minlength=batch.num_rows)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((seen & (BUCKETS - 1)).astype(np.int32)))
    yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "features": lists}


def _slices(rows: pa.Table, size: int = 256):
    """(features, row of each) of some examples at a time."""
    for a in range(0, rows.num_rows, size):
        lists = rows["features"].slice(a, size).combine_chunks()
        yield lists.flatten().to_numpy(), a + np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _fit(rows: pa.Table) -> dict[str, np.ndarray]:
    y = rows["label"].to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)
    weight = np.zeros(BUCKETS, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return {"weight": weight, "bias": np.array(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    pos, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for ids, row in _slices(rows):
        pos += np.bincount(ids[y[row] == 1], minlength=BUCKETS)
        every += np.bincount(ids, minlength=BUCKETS)
    a = 0.5
    ratio = np.log((pos + a) / (y.sum() + 2 * a)) - np.log((every - pos + a) / ((1 - y).sum() + 2 * a))
    # a feature counts if its ratio stands out from what its own number of documents makes likely
    spread = np.sqrt(1 / (pos + a) + 1 / (every - pos + a))
    used = (every >= LEAST_DOCUMENTS) & (np.abs(ratio) > 3 * spread)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(used.sum())
    parts = [(number[ids[keep]], row[keep].astype(np.int32)) for ids, row in _slices(rows) for keep in [used[ids]]]
    col, row = np.concatenate([c for c, _ in parts]), np.concatenate([o for _, o in parts])
    r = ratio[used] / 3
    w, b = np.zeros(len(r)), 0.0
    weighed = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    m, v, mb, vb = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    for t in range(1, 301):  # Adam over the whole sample, with an L2 penalty
        z = np.bincount(row, (w * r)[col], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weighed
        g = np.bincount(col, e[row], minlength=len(r)) * r + 1e-4 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weight[used] = (w * r).astype(np.float32)
    return {"weight": weight, "bias": np.array(b)}


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, label: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """The model: one weight for each hashed n-gram, and the bias."""
    rows = labelled_sample(id_text(docs, id_col, text_col), labels, label, F.lit(True) if train_rows is None else train_rows, max_rows)
    kind = dict(rows.dtypes)["doc_id"]
    return fitted(arrow_rows(rows, f"doc_id {kind}, label int, features array<int>", _features), _fit)


def probabilities(texts: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    h, owner = ngrams(texts)
    hit = np.flatnonzero(model["weight"][h])
    seen = np.unique((owner[hit].astype(np.int64) << BITS) | h[hit])
    z = np.bincount(seen >> BITS, model["weight"][seen & (BUCKETS - 1)], minlength=len(texts)) + float(model["bias"])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""
    src = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, score double", lambda batch: iter([{"doc_id": batch.column("doc_id"), "score": probabilities(text_bytes(batch), shared.value)}]))


def keep_rows(docs: DataFrame, model: dict[str, np.ndarray], below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is under ``below``."""
    from .common import kept_rows

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: probabilities(texts, shared.value) < below, text_col)
