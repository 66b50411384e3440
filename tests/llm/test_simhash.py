import random

import numpy as np
import xxhash
from conftest import TESTDATA
from odd import empty_documents, odd_documents, same_rows
from pyspark.sql import functions as F

from sylvaframe.llm import simhash
from sylvaframe.llm.components import connected_components
from sylvaframe.llm.queries import op9_simhash


def fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints=None):
    """All pairs of fingerprints, linked; the least id of each component."""
    prints = [fingerprint(t) for _, t in rows] if prints is None else prints
    nodes = sorted(set(prints))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(nodes, np.uint64)
    for i, f in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3):
            root[find(nodes[i + 1 + j])] = find(f)
    least = {}
    for (d, _), f in zip(rows, prints):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, prints)]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()]
    want = brute(rows)
    assert sum(d != c for d, _, c in want) > 20
    same_rows(op9_simhash(spark, f"{TESTDATA}/sf0.01"), want)


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    same_rows(got, brute(rows))
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def test_every_close_pair_shares_a_key():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, np.uint64)
    near = base.copy()
    for k in range(3):
        near ^= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
    keys = [{} for _ in range(2)]
    for side, prints in zip(keys, (base, near)):
        for row, key in zip(*simhash.segment_keys(prints)):
            side.setdefault(int(row), set()).add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(4000))


def test_crowded_keys_keep_components(spark):
    """Fingerprints that all agree in most bits, by pairs and by crowds."""
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(10)}
    while len(prints) < 400:
        prints.add(r.choice(sorted(prints)) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(prints)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    whole = simhash.links(nodes, crowd=10_000)
    arr = np.array(signed, np.int64).view(np.uint64)
    pairs = {tuple(sorted((signed[i], signed[j]))) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3) if i < j}
    assert {tuple(sorted((x.a, x.b))) for x in whole.collect()} == pairs
    for few in (simhash.links(nodes, crowd=4), simhash.links(nodes, crowd=4, forest=30)):
        assert {tuple(sorted((x.a, x.b))) for x in few.collect()} <= pairs
        assert {(x.node, x.root) for x in connected_components(few).distinct().collect()} == {(x.node, x.root) for x in connected_components(whole).distinct().collect()}


def test_a_crowd_emits_a_multiple_of_its_size(spark):
    """20,000 fingerprints that agree in two segments, in a spread of 18 bits: far more links than are given."""
    r = random.Random(9)
    open_ = [b for b in range(32)]
    r.shuffle(open_)
    prints = set()
    while len(prints) < 20_000:
        bits = r.getrandbits(18)
        prints.add(0x1234ABCD << 32 | sum((bits >> i & 1) << b for i, b in enumerate(open_[:18])))
    arr = np.array(sorted(prints), np.uint64)
    few = simhash.links(spark.createDataFrame([(int(f),) for f in arr], "fp bigint")).cache()
    assert few.count() < 20 * len(arr)
    got = {x.node: x.root for x in connected_components(few).distinct().collect()}
    root = {int(f): int(f) for f in arr}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    places = {int(f) for f in arr}
    flips = [1 << b for b in open_[:18]]
    for m in {a | b | c for a in flips for b in flips for c in flips}:
        other = arr ^ np.uint64(m)
        at = np.minimum(np.searchsorted(arr, other), len(arr) - 1)
        for f, g in zip(arr[(arr[at] == other) & (other > arr)].tolist(), other[(arr[at] == other) & (other > arr)].tolist()):
            root[find(f)] = find(g)
    groups = {}
    for f in places:
        groups.setdefault(find(f), set()).add(f)
    mine = {}
    for f in places:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(300, 299), (300, 299), (7, 7), (None, 3), (400, None)], "a bigint, b bigint")
    got = {(r.node, r.root) for r in connected_components(links).collect()}
    assert got == {(i, 1) for i in range(1, 201)} | {(299, 299), (300, 299)}
    assert connected_components(links.where("a is null")).count() == 0


def test_one_of_each_stays(spark):
    docs, rows = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    first = {}  # of each component the row with the least id, of rows with this id one
    for (d, t), (_, _, c) in zip(rows, brute(rows)):
        if d is not None and d == c:
            first.setdefault(component(rows, t), set()).add((d, t))
    got = [(r.doc_id, r.text or "") for r in kept.where("doc_id is not null").collect()]
    assert len(got) == len(first) and all(sum(g in f for g in got) == 1 for f in first.values())
    assert kept.where("doc_id is null").count() == 2
    assert simhash.keep_one(empty_documents(spark)).count() == 0


def component(rows, text):
    """The least fingerprint that can be reached from a text's."""
    prints = {fingerprint(t) for _, t in rows}
    seen, front = {fingerprint(text)}, [fingerprint(text)]
    while front:
        f = front.pop()
        new = {g for g in prints - seen if (f ^ g).bit_count() <= 3}
        seen |= new
        front += new
    return min(seen)


def test_repeated_ids_with_other_texts_stay(spark):
    a, b = "one text of five words", "some other words that nothing else has"
    docs = spark.createDataFrame([(1, a, "x"), (5, a, "y"), (5, b, "z"), (9, b, "w"), (9, b, "w")], "doc_id int, text string, source string")
    assert sorted((r.doc_id, r.source) for r in simhash.keep_one(docs).collect()) == [(1, "x"), (5, "z")]
    docs = spark.createDataFrame([(3, a, "x"), (3, a, "x"), (3, b, "z")], "doc_id int, text string, source string")
    assert sorted((r.doc_id, r.source) for r in simhash.keep_one(docs).collect()) == [(3, "x"), (3, "z")]


def test_null_is_the_empty_text(spark):
    """A null and an empty text under one id are one row too many."""
    docs = spark.createDataFrame([(1, None), (1, ""), (2, ""), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text or "") for r in simhash.keep_one(docs).where("doc_id is not null").collect()) == [(1, "")]
