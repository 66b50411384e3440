import zlib

import numpy as np
import pytest
from conftest import TESTDATA
from odd import empty_documents, odd_documents, odd_texts
from pyspark.sql import functions as F

from sylvaframe.llm import quality, toxicity
from sylvaframe.llm.labelled import LETTERS, fold, labelled_sample
from sylvaframe.llm.queries import op3_toxicity, op8_quality

SF = f"{TESTDATA}/sf0.1"


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return {"toxic": toxicity.train(docs, labels, fold("doc_id", 5) != 0), "quality": quality.train(docs, labels, fold("doc_id", 4) != 2)}


@pytest.mark.parametrize("query, label, parts, held, least", [(op3_toxicity, "toxic", 5, 0, 0.5), (op8_quality, "quality", 4, 2, 0.7)])
def test_held_out(spark, query, label, parts, held, least):
    rows = query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 500 and np.mean(right) > 0.95


def test_toxicity_scores_are_sums_over_distinct_ngrams(models):
    model = models["toxic"]
    texts = [(t or "").encode() for t in odd_texts()][:-1]
    got = toxicity.probabilities(texts, model)
    for text, p in zip(texts, got):
        clean = bytes(LETTERS[np.frombuffer(text, np.uint8)]) if text else b""
        padded = b" " * 6 + clean + b" " * 6
        seen = set()
        for i in range(len(text) + 6):
            four = int.from_bytes(padded[i : i + 4], "little")
            if four == 0x20202020:
                continue
            mixed = four * 2654435761 % 2**32
            seen |= {mixed >> 12, ((mixed ^ (padded[i + 4] * 2246822519 % 2**32)) * 2654435761 % 2**32) >> 12}
        z = sum(float(model["weight"][h]) for h in seen) + float(model["bias"])
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-6


def test_machine_sums_all_pairs(models):
    """The sum-of-squares identity against the sum over all pairs of features."""
    m = models["quality"]
    texts = [(t or "").encode() for t in odd_texts()][:-1]
    stats, words, owner = quality.statistics(texts)
    ids, x, size = quality._rows(stats, words, owner, m["edges"])
    got, at = quality.probabilities(texts, m), 0
    for p, n in zip(got, size):
        i, xi = ids[at : at + n], x[at : at + n].astype(float)
        at += n
        z = float(m["b"]) + (m["w"][i] * xi).sum()
        for a in range(n):
            for b in range(a + 1, n):
                z += float(m["v"][i[a]].astype(float) @ m["v"][i[b]].astype(float)) * xi[a] * xi[b]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-3


@pytest.mark.parametrize("module, name", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, models, module, name):
    docs, rows = odd_documents(spark)
    got = module.score(docs, models[name])
    want = {(d, round(float(module.probabilities([t.encode()], models[name])[0]), 4)) for d, t in rows}
    assert got.count() == len(rows) and {(r.doc_id, round(r.score, 4)) for r in got.collect()} <= {(d, round(s + e, 4)) for d, s in want for e in (-1e-4, 0, 1e-4)}
    kept = module.keep_rows(docs, models[name])
    assert kept.schema == docs.schema
    bar = 0.7 if name == "quality" else 0.5
    n = got.where(F.col("score") >= bar).count() if name == "quality" else got.where(F.col("score") < bar).count()
    assert kept.count() == n
    assert module.score(empty_documents(spark), models[name]).count() == 0
    assert module.keep_rows(empty_documents(spark), models[name]).count() == 0


@pytest.mark.parametrize("module, name", [(toxicity, "toxic"), (quality, "quality")])
def test_few_or_no_labels(spark, module, name):
    docs, _ = odd_documents(spark)
    none = spark.createDataFrame([], f"doc_id bigint, {name} int")
    assert all(r.score < 0.01 for r in module.score(docs, module.train(docs, none)).collect())
    ones = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (6, None)], f"doc_id bigint, {name} int")
    assert all(r.score > 0.99 for r in module.score(docs, module.train(docs, ones)).collect())


def test_sample_is_bounded_and_consistent(spark):
    docs, _ = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (4, 1)], "doc_id bigint, toxic int")
    ids = [r.doc_id for r in labelled_sample(docs.select("doc_id", "text"), labels, "toxic", F.lit(True), 10).select("doc_id").distinct().collect()]
    assert len(ids) <= 10 and 4 not in ids  # 4 is labelled 0 and 1


def test_toxicity_fit_against_a_dense_one():
    """Ratios and weights of the fit against the same sums over a dense table of documents and features."""
    import math

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(7)
    y = (r.random(60) < 0.3).astype(int)
    ids = [sorted({int(i) for i in r.integers(0, 40, 12)} | ({100, 101} if t else {200}) | ({300} if k % 2 else set())) for k, t in enumerate(y)]
    rows = pa.table({"doc_id": range(60), "label": y, "features": pa.array(ids, pa.list_(pa.int32()))})
    got = toxicity._fit(rows)
    names = sorted({i for x in ids for i in x})
    x = np.array([[i in row for i in names] for row in ids], float)
    ratio, used = [], []
    for f in range(len(names)):
        pos = sum(1 for k in range(60) if x[k][f] and y[k])
        neg = sum(1 for k in range(60) if x[k][f] and not y[k])
        ratio.append(math.log((pos + 0.5) / (y.sum() + 1)) - math.log((neg + 0.5) / ((1 - y).sum() + 1)))
        used.append(pos + neg >= toxicity.LEAST_DOCUMENTS and abs(ratio[-1]) > 3 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))
    at = [f for f in range(len(names)) if used[f]]
    assert {names[f] for f in at} >= {100, 101}
    x, scale = x[:, at] * np.array(ratio)[at] / 3, np.array(ratio)[at] / 3
    p = np.zeros(len(at) + 1)  # weights and bias, Adam on the weighted loss
    m, v = np.zeros_like(p), np.zeros_like(p)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, 301):
        e = (1 / (1 + np.exp(-(x @ p[:-1] + p[-1]))) - y) * each
        g = np.append(x.T @ e + 1e-4 * p[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got["weight"][[names[f] for f in at]], p[:-1] * scale, atol=1e-5) and abs(float(got["bias"]) - p[-1]) < 1e-6
    assert np.count_nonzero(got["weight"]) == len(at)
