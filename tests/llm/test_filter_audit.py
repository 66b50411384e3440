import random
from collections import defaultdict
from itertools import permutations

import pytest
from conftest import TESTDATA
from odd import empty_documents, odd_documents, same_rows
from pyspark.sql import functions as F

from sylvaframe.llm import filter_audit
from sylvaframe.llm.queries import op12_filter_audit


def failures(text, repeats):
    words, capitals = text.encode().split(), sum("A" <= c <= "Z" for c in text)
    tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), any(c in "#$%&*|" for c in text), repeats]
    return {f for f, t in zip("ABCDE", tests) if t}


def brute(rows, labels):
    """Every order filter by filter, document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in rows:
        parts[source or ""].append((i, failures(text or "", i is not None and i > least[text or ""])))
    out = []
    for part, docs in parts.items():
        steps, total = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                fails = sum(f in d[1] for d in docs)
                steps.append(("".join(order), step, f, len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(part, *s[:2], *s[3:], total[s[2]]) for s in steps]
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()
    labels = spark.read.parquet(f"{TESTDATA}/sf0.001/labels.parquet").collect()
    same_rows(op12_filter_audit(spark, f"{TESTDATA}/sf0.001"), brute([(r.doc_id, r.text, r.source) for r in docs], [(r.doc_id, r.quality, r.toxic) for r in labels]))


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, None), (None, 1, 1), (7, 1, 1), (8, 0, 1), (99_999, 1, 1), (20, 1, 0), (21, 1, 1)]


def test_odd_rows(spark):
    """Null texts, sources, ids and labels, repeated rows and ids, several labels of one id, and extra columns with clashing names."""
    docs, _ = odd_documents(spark)
    docs = docs.withColumns({"source": F.when(F.col("n_chars") % 3 == 0, F.lit("a")).when(F.col("n_chars") % 3 == 1, F.lit("")), "part": F.lit(1), "id": F.lit("x"), "digest": F.lit(2), "A": F.lit(3)})
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    same_rows(filter_audit.audit(docs, labels), brute(rows, LABELS))


def test_copies_share_a_text(spark):
    """Copies by the thousand, of one text and of one row."""
    text = "word " * 60
    rows = [(i % 2000, text, "s" if i % 2 else None) for i in range(6000)] + [(5, text, None)] * 500 + [(-1, text + "|", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    same_rows(filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")), brute(rows, LABELS))


@pytest.mark.parametrize("k", [1, 3, 6])
def test_zeta_and_chosen_orders(spark, k):
    r = random.Random(k)
    names = [f"f{i}" for i in range(k)]
    rows = [(r.choice("pq"), 1 + r.randrange(3), *[r.random() < 0.4 for _ in range(k)], r.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, n int, " + ", ".join(f"{f} boolean" for f in names) + ", seen boolean")
    counts = filter_audit.mask_counts(df, names, ["seen"])
    for part, *arrays in filter_audit.survivors(counts, k).collect():
        mine = [x for x in rows if x[0] == part]
        for s in range(1 << k):
            left = [x for x in mine if not any(x[2 + i] for i in range(k) if s >> i & 1)]
            assert arrays[0][s] == sum(x[1] for x in left)
            assert arrays[1][s] == sum(x[1] for x in left if x[-1])
    order = tuple(r.sample(names, k))
    for row in filter_audit.steps(counts, names, {"seen_lost": "seen"}, [order]).collect():
        mine = [x for x in rows if x[0] == row.part]
        before = [names.index(f) for f in order[: row.step - 1]]
        this = names.index(order[row.step - 1])
        gone = [x for x in mine if x[2 + this] and not any(x[2 + i] for i in before)]
        assert row.filter_order == "".join(order)
        assert (row.removed, row.seen_lost) == (sum(x[1] for x in gone), sum(x[1] for x in gone if x[-1]))


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.mask_counts(spark.range(1), [str(i) for i in range(13)], [])


def test_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty_documents(spark), labels).count() == 0
    docs, _ = odd_documents(spark, ["a b", None])
    assert filter_audit.audit(docs, labels).count() == 600
