"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words (letters only, A-Z lower-cased, hashed to ``WORDS`` values, each with
value one over the square root of their number) and, for each statistic of ``statistics`` (shares of
upper case, digits, marks and bars, repeats of words and lines, lengths ...), one of ``BINS`` bins with
value one. Metadata are those that every text has of itself, its numbers of bytes, words and lines; language,
source, id and labels are no inputs. With weights w and factors v of rank ``RANK`` the score is
the logistic function of ``b + sum(w x) + 1/2 sum_f((sum(v_f x))^2 - sum(v_f^2 x^2))``: all pairs of
features interact, in time linear in their number.

The fit uses at most ``MAX_ROWS`` labelled documents (those with the least hash of the id) in one task;
scoring covers every row where it lies, without a shuffle. Null and empty texts are scored like any other (no words, the
lowest bins). Without labels, or with one class only, every score is the share of that class (0 without
labels). Equal or null ids are scored row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, kept_rows, span_hashes
from .labelled import LETTERS, fitted, joined, labelled_sample, text_bytes

BITS = 16
WORDS = 1 << BITS
BINS = 16
RANK = 8
MAX_ROWS = 8000

def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text (rows), and its distinct words as (hash, owner)."""
    raw, first, last = joined(texts)
    n = len(texts)
    size = np.maximum(last - first, 1).astype(np.float64)
    edges = np.concatenate([[0], last])

    def per_text(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[edges[1:]] - total[edges[:-1]]).astype(np.float64)

    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    stop = (raw == 46) | (raw == 44) | (raw == 32) | (raw == 10)
    mark = (raw < 128) & ~upper & ~lower & ~digit & ~stop
    bar, bang = raw == 124, raw == 33
    shares = [per_text(x) / size for x in (upper, digit, mark, bar, bang, raw == 46, raw == 32, raw >= 128)]

    ws, we = spans((raw > 32))
    who = np.searchsorted(last, ws, side="right")
    words = np.bincount(who, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    clean = LETTERS[raw]
    ls, le = spans(clean != 32)
    lwho = np.searchsorted(last, ls, side="right")
    lh = span_hashes(clean, ls, le)
    letters = np.maximum(np.bincount(lwho, minlength=n), 1).astype(np.float64)
    again = np.zeros(n)
    if len(lh):
        same = (lh[1:] == lh[:-1]) & (lwho[1:] == lwho[:-1])
        again = np.bincount(lwho[1:][same], minlength=n) / letters
    bucket = (lh >> np.uint64(64 - BITS)).astype(np.int64)
    pairs, counts = np.unique((lwho.astype(np.int64) << BITS) | bucket, return_counts=True)
    owner = pairs >> BITS
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, counts)
    # words with a mark behind or before them, and pairs of words that stand in the text before
    marked = np.bincount(who[mark[ws] | mark[we - 1]], minlength=n) / some
    if len(lh) > 1:
        two = (lh[:-1] * np.uint64(3) + lh[1:]) | np.uint64(1)
        inside = lwho[:-1] == lwho[1:]
        key = np.unique((two[inside] >> np.uint64(20)).astype(np.int64) ^ (lwho[:-1][inside].astype(np.int64) << 44), return_index=True)[1]
        new_pairs = np.bincount(lwho[:-1][inside][key], minlength=n) / letters
    else:
        new_pairs = np.zeros(n)
    breaks = per_text(raw == 10)
    columns = [*shares, again, distinct / letters, most / letters, marked, new_pairs, size / some, breaks / some, np.log1p(size), np.log1p(words), np.log1p(breaks)]
    return np.stack(columns, 1), pairs & (WORDS - 1), owner


N_STATISTICS = 18
FEATURES = WORDS + N_STATISTICS * BINS


def _examples(batch):
    stats, words, owner = statistics(text_bytes(batch))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
    yield {
        "doc_id": batch.column("doc_id"),
        "label": batch.column("label"),
        "stats": pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel())),
        "words": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words.astype(np.int32))),
    }


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([WORDS + k * BINS + np.searchsorted(edges[k], stats[:, k], side="left") for k in range(stats.shape[1])], 1)


def _rows(stats, words, owner, edges):
    """Features, values and owners of all texts, sorted by owner."""
    n = len(stats)
    many = np.bincount(owner, minlength=n)
    ids = np.concatenate([_binned(stats, edges).ravel(), words])
    own = np.concatenate([np.repeat(np.arange(n), stats.shape[1]), owner])
    value = np.concatenate([np.ones(n * stats.shape[1]), 1 / np.sqrt(np.maximum(many, 1))[owner]])
    order = np.argsort(own, kind="stable")
    return ids[order], value[order].astype(np.float32), many + stats.shape[1]


def _sums(value, cuts):
    return np.add.reduceat(value, cuts[:-1], axis=0)  # every text has the features of its statistics


def _raw_scores(ids, x, size, w, v, b):
    cuts = np.concatenate([[0], np.cumsum(size)])
    vx = v[ids] * x[:, None]
    s = _sums(vx, cuts)
    return b + _sums(w[ids] * x, cuts) + 0.5 * (s * s - _sums(vx * vx, cuts)).sum(1), s


def _fit(rows: pa.Table) -> dict[str, np.ndarray]:
    y = rows["label"].to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)
    rng = np.random.default_rng(7)
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)
    share = float(y.mean()) if len(y) else 0.0
    edges = np.zeros((N_STATISTICS, BINS - 1))
    if not 0 < share < 1:
        return {"w": w, "v": v * 0, "b": np.array(np.log((share + 1e-6) / (1 - share + 1e-6))), "edges": edges}
    stats = rows["stats"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    lists = rows["words"].combine_chunks()
    words, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    # bin edges: quantiles of both classes together, each class with half the weight
    q = np.linspace(0, 1, 2 + (BINS - 1) // 2)[1:-1]
    for k in range(N_STATISTICS):
        e = np.concatenate([np.quantile(stats[y == 0, k], q), np.quantile(stats[y == 1, k], q)])
        edges[k] = np.sort(np.concatenate([e, np.full(BINS - 1 - len(e), e.max())]))
    ids, x, size = _rows(stats, words, np.repeat(np.arange(len(y)), many), edges)
    starts = np.cumsum(size) - size
    b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(FEATURES, 1e-4, np.float32), np.full((FEATURES, RANK), 1e-4, np.float32), 1e-4
    for epoch in range(8):  # AdaGrad over small batches
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            at = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in part])
            i, xi = ids[at], x[at]
            z, s = _raw_scores(i, xi, size[part], w, v, b)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32)
            er = np.repeat(e, size[part])
            uniq, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, er * xi, len(uniq)).astype(np.float32) / len(part) + 1e-5 * w[uniq]
            full = (er * xi)[:, None] * (np.repeat(s, size[part], 0) - v[i] * xi[:, None])
            dv = np.stack([np.bincount(inv, full[:, f], len(uniq)) for f in range(RANK)], 1).astype(np.float32) / len(part) + 1e-4 * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            gb += float(e.mean()) ** 2
            w[uniq] -= 0.1 * dw / np.sqrt(gw[uniq])
            v[uniq] -= 0.03 * dv / np.sqrt(gv[uniq])
            b -= 0.1 * float(e.mean()) / gb**0.5
    return {"w": w, "v": v, "b": np.array(b), "edges": edges}


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """The model: weights, factors, bias and bin edges, of a size fixed by ``FEATURES`` and ``RANK``."""
    rows = labelled_sample(id_text(docs, id_col, text_col), labels, label, F.lit(True) if train_rows is None else train_rows, max_rows)
    kind = dict(rows.dtypes)["doc_id"]
    return fitted(arrow_rows(rows, f"doc_id {kind}, label int, stats array<double>, words array<int>", _examples), _fit)


def probabilities(texts: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    ids, x, size = _rows(*statistics(texts), model["edges"])
    z, _ = _raw_scores(ids, x, size, model["w"], model["v"], float(model["b"]))
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""
    src = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and RANK
    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, score double", lambda batch: iter([{"doc_id": batch.column("doc_id"), "score": probabilities(text_bytes(batch), shared.value)}]))


def keep_rows(docs: DataFrame, model: dict[str, np.ndarray], least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: probabilities(texts, shared.value) >= least, text_col)
