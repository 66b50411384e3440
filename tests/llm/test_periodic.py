import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import TESTDATA
from odd import empty_documents, odd_documents, same_rows

from sylvaframe.llm import periodic
from sylvaframe.llm.queries import op13_periodic_runs


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(6, 4 * p):
                part = words[i : i + size]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out)


def brute_kept(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    same_rows(op13_periodic_runs(spark, f"{TESTDATA}/sf0.001"), [brute(r.doc_id, r.text) for r in docs])


def planted(r, n, letters):
    words = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(4)):
        if n > 4:
            a, p = r.randrange(n), r.randint(1, max(1, n // 5))
            for i in range(a + p, r.randint(a, n)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("probes, chunk, least", [(1 << 18, 1 << 16, 64), (8, 3, 2), (64, 16, 2)])
def test_random_words(monkeypatch, probes, chunk, least):
    monkeypatch.setattr(periodic, "PROBES", probes)
    monkeypatch.setattr(periodic, "LARGEST_CHUNK", chunk)
    monkeypatch.setattr(periodic, "FIRST_CHUNK", least)
    r = random.Random(probes)
    for _ in range(400):
        words = planted(r, r.choice([0, 1, 5, 6, 7, 8, 12, 20, 40, 80, 150]), r.choice([1, 2, 2, 3, 5]))
        x = np.array(words, np.int32)
        found = periodic.runs(x)
        assert found == brute_runs(words)
        assert [w for w, k in zip(words, periodic.kept(len(words), found)) if k] == brute_kept(words, found)
        for p in range(1, len(words) // 4):
            by_place = sorted({periodic.stretch(x, i, p) for i in range(len(words) - p) if words[i] == words[i + p]})
            assert periodic.all_stretches(x, p) == by_place


def test_long_texts():
    """Half a million words, alike, of two kinds, or a long period, take seconds."""
    n = 500_000
    assert periodic.runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    assert periodic.runs(np.tile(np.arange(50_000, dtype=np.int32), 10)) == [(0, n, 50_000)]
    two = np.random.default_rng(1).integers(0, 2, n).astype(np.int32)
    starts = {s for s, _, p in periodic.runs(two) if p == 1}
    turns = np.flatnonzero(np.diff(two, prepend=-1, append=-1))
    assert starts == {int(a) for a, b in zip(turns[:-1], turns[1:]) if b - a >= 6}


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    plain = periodic.periodic_runs(docs).collect()
    assert len(plain) == len(rows)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in plain), key=repr)
    want = []
    for doc_id, text in rows:
        words = text.encode().split()
        runs = brute_runs(words) if len(words) < 5000 else periodic.runs(periodic.numbered(words))
        want.append((doc_id, len(words), runs, b" ".join(brute_kept(words, runs)).decode()))
    assert got == sorted(want, key=repr)


def test_planted_rows(spark):
    """Ids whose CRC-32 ends in 0, null ids, and texts without words."""
    ids = [i for i in range(-400, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n", "a", "b c", "x y z x y z", *(" ".join(f"w{k}" for k in range(n)) for n in (3, 17, 200))]
    rows = [(i, t) for i in ids for t in texts] + [(None, "a a a a a a"), (None, None)]
    df = periodic.with_planted_runs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()]
    lines = [(i, len(runs), hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for i, runs, text in got]
    want = [(b[0], b[1], b[6], b[7]) for b in (brute(*r) for r in rows)]
    assert sorted(lines, key=repr) == sorted(want, key=repr)


def test_ties_of_the_longest(spark):
    df = spark.createDataFrame([(1, "a a a a a a b c c c c c c"), (2, "x")], "doc_id bigint, text string")
    rows = {r.doc_id: r.best for r in periodic.periodic_runs(df).withColumn("best", periodic.longest(periodic.F.col("runs"))).collect()}
    assert tuple(rows[1]) == (0, 6, 1) and rows[2] is None


def test_no_documents(spark):
    assert periodic.periodic_runs(empty_documents(spark)).count() == 0
