import hashlib
import re
import struct

import xxhash
from conftest import TESTDATA
from odd import empty_documents, odd_documents, same_rows
from pyspark.sql import functions as F

from sylvaframe.llm import fingerprint as P
from sylvaframe.llm.queries import op5_fingerprints


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def sketch(words):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    hashes = []
    for i in range(max(len(words) - 5, 0) + 1):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        hashes.append(signed(h))
    low = {h for h in hashes if h < -(1 << 63) + (1 << 64) // 8}
    return sorted(low) if low else [min(hashes)]


def words_of(text):
    return re.split("[ \\t\\n\\r\\f\\x0b]+", text.lower().strip(" \t\n\r\f\x0b"))


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def hexed(s):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in s)


def brute(rows):
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (sketch(words_of(x)) for x in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c), len(set(a) & set(b)) / len(a), len(set(a) & set(b)) / len(b)))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = op5_fingerprints(spark, f"{TESTDATA}/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    same_rows(got, brute([(r.doc_id, r.text or "") for r in docs]))


def test_blocks(spark, monkeypatch):
    """Neighbours across the bounds of blocks, and after the last document."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 3)
    texts = [None, "", "a b c d e f g", "a b c d e f g", "x y", "😀😀😀 z", *(f"w{i} v{i % 3} u t s r q p" for i in range(40))]
    rows = [(5 * i, t or "") for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "x") for (d, _), t in zip(rows, texts)], "doc_id bigint, text string, own string").repartition(4)
    got = P.edited_pairs(df)
    want = [(d, t, t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2]) for i, (d, t) in enumerate(rows)]
    same_rows(got.select("doc_id", "text", "edited"), want)


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    got = P.fingerprints(docs)
    want = {}
    for d, t in rows:
        if not re.search("[^\x00-\x7f]", t):  # lower case beyond ASCII is Java's
            want.setdefault(d, []).append(sketch(words_of(t)))
    for r in got.collect():
        if r.doc_id in want and r.doc_id not in (7, 8, None):
            assert r.sketch in want[r.doc_id]
    assert got.count() == len(rows) and P.edited_pairs(docs).count() == len(rows)
    assert P.edited_pairs(empty_documents(spark)).count() == 0


def test_sketches_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, "q r s t u v w x y z")], "doc_id bigint, text string")
    a, b = (r.sketch for r in P.fingerprints(df, scale=1).orderBy("doc_id").collect())
    both = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    row = both.select(P.merged(F.col("a"), F.col("b"), 1).alias("m"), P.containment(F.col("a"), P.merged(F.col("a"), F.col("b"), 1)).alias("c"), P.resemblance(F.col("a"), F.col("b")).alias("r")).head()
    assert row.m == sorted({*a, *b}) and row.c == 1.0 and row.r == 0.0


def test_sketches_merge_by_the_threshold(spark):
    """The sketch of a whole is that of its parts' sketches, also where a part has no hash under the threshold."""
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(n))) for i, n in enumerate([5, 5, 5, 6, 7, 5, 40, 5, 5, 6, 5, 200])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts = {r.doc_id: r.sketch for r in P.fingerprints(df).collect()}
    top = -(1 << 63) + (1 << 64) // P.SCALE - 1
    assert any(s[0] > top for s in parts.values()) and any(s[0] <= top for s in parts.values())
    hashes = {r.doc_id: r.sketch for r in P.fingerprints(df, scale=1).collect()}
    pairs = [(i, j) for i in parts for j in parts if i < j]
    table = spark.createDataFrame([(i, j, parts[i], parts[j]) for i, j in pairs], "i int, j int, a array<bigint>, b array<bigint>")
    for r in table.select("i", "j", P.merged(F.col("a"), F.col("b")).alias("m")).collect():
        both = {*hashes[r.i], *hashes[r.j]}
        assert r.m == (sorted(h for h in both if h <= top) or [min(both)])


def test_ids_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 3)
    texts = [f"text {i} of some words" for i in range(23)]
    df = spark.createDataFrame([(f"id-{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(4)
    want = [(f"id-{i:03}", t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]) for i, t in enumerate(texts)]
    same_rows(P.edited_pairs(df).select("doc_id", "edited"), want)
