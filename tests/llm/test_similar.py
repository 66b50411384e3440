import random
import re

import numpy as np
from conftest import TESTDATA
from odd import empty_documents, odd_documents

from sylvaframe.llm import similar


def shingle_set(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def pairs_of(sets, least=0.8):
    """All pairs of different sets with that Jaccard similarity, through their common shingles."""
    having, out = {}, set()
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in having.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            having[x].append(i)
        out |= {(j, i) for j, n in common.items() if n >= least * (len(s) + len(sets[j]) - n)}
    return out


def groups(rows, least=0.8):
    """The ids of each class by brute force."""
    nodes = {}
    for d, t in rows:
        nodes.setdefault(frozenset(shingle_set(t)), []).append(d)
    sets = list(nodes)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_of(sets, least):
        root[find(a)] = find(b)
    out = {}
    for i, s in enumerate(sets):
        out.setdefault(find(i), []).extend(nodes[s])
    return [set(g) for g in out.values()]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["class"], set()).add(r.doc_id)
    return list(out.values())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def near_copies(seed=3):
    """Groups of edited copies from similarity 0.7 to 1, and texts that share half."""
    r = random.Random(seed)
    rows = []
    for g in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 300))]
        for k in range(r.randint(1, 6)):
            rows.append((len(rows), edited(r, base, r.randint(0, max(1, len(base) // 60)))))
        rows.append((len(rows), " ".join(base[: len(base) // 2] + [f"x{r.randrange(3000)}" for _ in base[len(base) // 2 :]])))
    return rows


def test_recall_and_exact_links(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got, want = found(similar.similar_texts(docs)), groups(rows)
    assert all(any(g <= w for w in want) for g in got)  # nothing is joined that brute force keeps apart
    assert len(got) - len(want) <= 0.05 * (len(rows) - len(want))
    few = found(similar.similar_texts(docs, crowd=2))  # crowds lose no class
    assert sorted(map(sorted, few)) == sorted(map(sorted, got))


def test_pair_recall():
    """Isolated pairs at similarities from 0.80 to 0.82: at least nine of ten share a key and are close enough to be verified."""
    r = random.Random(1)
    met = []
    while len(met) < 250:
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(100, 400))]
        texts = [" ".join(base), edited(r, base, max(1, len(base) // 48))]
        a, b = map(shingle_set, texts)
        if not 0.8 <= len(a & b) / len(a | b) <= 0.82:
            continue
        prints = [similar.fingerprint(similar.shingles(t.encode())) for t in texts]
        low, high = (np.array(c, np.int64) for c in zip(*prints))
        row, key = similar.band_keys(low, high)
        near = similar._differ(low[:1], high[:1], low[1:], high[1:])[0] <= similar.DISTANCE
        met.append(bool(near) and bool(set(key[row == 0].tolist()) & set(key[row == 1].tolist())))
    assert sum(met) >= 0.9 * len(met)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()]
    got, want = found(similar.similar_texts(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet"))), groups(rows)
    assert all(any(g <= w for w in want) for g in got)
    assert len(got) - len(want) <= 0.05 * (len(rows) - len(want))


def test_crowd_of_near_copies(spark):
    """Hundreds of copies with the same and with other fingerprints: one class, with about as many candidates as copies."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, edited(r, base, r.randint(0, 4))) for i in range(700)] + [(1000 + i, " ".join(f"y{i}-{k}" for k in range(30))) for i in range(50)]
    got = found(similar.similar_texts(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), crowd=20))
    want = groups(rows)
    assert all(any(g <= w for w in want) for g in got)
    assert len(got) - len(want) <= 3


def test_large_keys_lose_no_link(spark):
    """Short texts in crowds, many below the similarity of the largest component, with links among themselves: the prefix filter finds all links
    that meetings member by member find, and such between members of different keys, too."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        first = edited(r, base, r.randint(0, 4)).split()
        rows.append((2 * i, " ".join(first)))
        rows.append((2 * i + 1, edited(r, first, r.randint(0, 1))))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    by_prefix, by_member = found(similar.similar_texts(docs, few=1, distance=115)), found(similar.similar_texts(docs, few=10**6, distance=115))
    assert all(any(g <= p for p in by_prefix) for g in by_member)
    want = groups(rows)
    assert all(any(g <= w for w in want) for g in by_prefix) and len(by_prefix) - len(want) <= 0.1 * (len(rows) - len(want))


def test_parity_bounds_the_difference():
    r = np.random.default_rng(4)
    for n, new in [(0, 3), (5, 0), (150, 20), (3000, 900)]:
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[new // 2 :], r.integers(0, 2**63, new).astype(np.uint64)])
        differ = np.bitwise_count(np.bitwise_xor(*(np.array(similar.parity(x), np.int64) for x in (a, b))).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))
        assert (new > 0) or differ == 0


def test_crowd_in_small_keys(spark, monkeypatch):
    """A group of near copies and texts a little too far from it, together in many small keys: few pairs become rows, and no link is left out."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(r, base, r.randint(0, 2))) for i in range(300)]
    for i in range(80):
        far = edited(r, base, 7).split()
        rows += [(1000 + 2 * i, " ".join(far)), (1001 + 2 * i, edited(r, far, 2))]
    made, stored = [], similar.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "crowd-candidates":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "stored", counted)
    got, want = found(similar.similar_texts(spark.createDataFrame(rows, "doc_id int, text string").repartition(4))), groups(rows)
    assert all(any(g <= w for w in want) for g in got) and len(got) - len(want) <= 2
    assert made[-1] <= 2 * len(rows)


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    out = similar.similar_texts(docs)
    assert out.count() == docs.count()
    got, want = found(out), groups(rows)
    key = lambda g: sorted((x is None, x or 0) for x in g)
    assert sorted(map(key, got)) == sorted(map(key, want))
    for r in out.collect():
        cls = next(g for g in got if r.doc_id in g)
        assert r.component_id is None or r.component_id <= (r.doc_id if r.doc_id is not None else r.component_id) or r.component_id in cls
    kept = similar.keep_one(docs)
    assert kept.schema == docs.schema and kept.where("doc_id is null").count() == 2
    assert similar.keep_one(empty_documents(spark)).count() == 0
