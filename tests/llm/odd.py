"""Small tables with everything that may stand in a column, for the tests of the text operators."""

import random

WORDS = "the of license mit License Apache gnu General PUBLIC license ünder été naïve 中文 don't we'LL 123 4.0 x_y [ok] a b c d e |".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, score double, fp bigint, features string, key string, n int, sequence_id bigint, word string, _block int"


#: Two words whose polynomial hashes modulo 2^64 agree for every odd multiplier.
TWINS = tuple("".join(ab[bin(i).count("1") % 2] for i in range(1024)) for ab in ("ab", "ba"))


def odd_texts(seed=1, n=40):
    r = random.Random(seed)
    texts = [None, "", " ", "\n\n\t ", "a", "MIT License", "mit\nlicense mit license", "Licensed under the Apache License, Version 2.0.", "general  public-license", "x" * 700, "ab" * 300, "😀 é́   end", "Σίσυφος ΟΔΟΣ ſ İ", "don't they'LL I'd'", "!!! ??? ...", "１２٣४ 42", "a\x00b \x1c\x1d c", " x　y​\u0085z", "tab\tsep\x0bvt\x0cff\r\n"]
    for _ in range(n):
        texts.append(r.choice([" ", "  ", "\n"]).join(r.choice(WORDS) for _ in range(r.randint(1, 60))))
    texts += texts[-5:] + [texts[-1] + " more"]
    texts += [*TWINS, f"{TWINS[1]} {TWINS[0]} twins"]
    texts.append(" ".join(r.choice(WORDS) + str(r.randint(0, 3000)) for _ in range(30_000)))
    return texts


def rows_of(texts, first=0):
    return [(first + i, t, None if i % 3 else "en", None, i, i % 2, 0.5, 7, "f", "k", None, 3, "w", None) for i, t in enumerate(texts)]


def odd_documents(spark, texts=None, parts=3):
    """Texts with ascending ids, one repeated row, one repeated id, two null ids, and many extra columns."""
    texts = odd_texts() if texts is None else texts
    rows = rows_of(texts)
    a, b = rows[7 % len(rows)], rows[8 % len(rows)]
    rows += [a, (b[0], "another text under this id", *b[2:]), (None, "no id here", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id"), [(r[0], r[1] or "") for r in rows]


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df, expected):
    """Rows as a multiset, nulls and all."""
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted((tuple(r) for r in expected), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
