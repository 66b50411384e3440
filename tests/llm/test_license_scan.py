import re

import numpy as np
from conftest import TESTDATA
from odd import empty_documents, odd_documents, same_rows

from sylvaframe.llm import license_scan as L
from sylvaframe.llm.queries import op2_license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(rows):
    """Every template tried at every place of every text."""
    texts = [words_of(t) for _, t in rows]
    vocabulary = {w for t in L.BASE + L.NOTICES for w in t.text.split()}
    df = {w: sum(w in set(x) for x in texts) for w in vocabulary}
    idf = {w: float(np.log((len(rows) + 1) / (df[w] + 1))) + 1e-3 for w in vocabulary}
    out = []
    for (doc, _), words in zip(rows, texts):
        found = []
        for t in L.BASE + L.NOTICES:
            own, spans = t.text.split(), L._spans(t)
            a, b = spans[0]
            for at in places(words, " ".join(own[a:b])):
                begin = at - a
                if all(0 <= begin + x and begin + y <= len(words) and words[begin + x : begin + y] == own[x:y] for x, y in spans):
                    same = sum(idf[w] for i, w in enumerate(own) if 0 <= begin + i < len(words) and words[begin + i] == w)
                    found.append((t.label, t.base, begin, same / sum(idf[w] for w in own)))
        base = [f for f in found if f[1]]
        join = lambda x: ",".join(sorted({f[0] for f in x}))
        out.append((doc, len(words), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None), join(base), join(found), round(max((f[3] for f in found), default=0.0), 9)))
    return out


def rounded(df):
    from pyspark.sql import functions as F

    return df.withColumn("score", F.round("score", 9))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()
    found = op2_license_scan(spark, f"{TESTDATA}/sf0.01")
    assert found.where("labels <> ''").count() > 10
    same_rows(rounded(found), brute([(r.doc_id, r.text or "") for r in docs]))


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    same_rows(rounded(L.summary(L.scan(docs))), brute(rows))
    assert L.summary(L.scan(empty_documents(spark))).count() == 0


def test_notice_that_begins_before_the_text(spark):
    """The first words of a template may be missing; its mandatory phrases may not."""
    texts = ["free charge", "of the software and associated documentation files", "permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and associated documentation files", "under the gnu lesser general public license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.summary(L.scan(docs)).collect()}
    assert [got[i].labels for i in range(4)] == ["", "", "mit", "gpl,lgpl"]
