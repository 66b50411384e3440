import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import TESTDATA
from odd import empty_documents, odd_documents, odd_texts, same_rows

from sylvaframe.llm import byte_bpe
from sylvaframe.llm.queries import op1_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(doc, text, ids):
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_against_tiktoken(spark, plain):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()
    same_rows(op1_byte_bpe(spark, f"{TESTDATA}/sf0.001"), [digests(r.doc_id, r.text or "", plain.encode_ordinary(r.text or "")) for r in docs])


@pytest.mark.parametrize("block", [1000, 1 << 25])
def test_odd_rows(spark, ranks, plain, block):
    docs, rows = odd_documents(spark)
    got = byte_bpe.encode(docs, ranks, block_bytes=block)
    got = byte_bpe.decode(got, ranks, name="raw")
    same_rows(got.selectExpr("doc_id", "ids", "cast(raw as binary) as raw"), [(d, plain.encode_ordinary(t), bytearray(t.encode())) for d, t in rows])
    assert byte_bpe.encode(empty_documents(spark), ranks).count() == 0


def test_long_runs(spark, ranks, plain):
    """Runs of one letter or sign, as of ruled lines, take time in proportion to their length."""
    texts = ["a" * 300_000, "-" * 300_000, "ab" * 2000, "x" + "=" * 257 + "y", " " * 5000 + "z", "-" * 256]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    same_rows(byte_bpe.encode(docs, ranks).select("doc_id", "ids"), [(i, plain.encode_ordinary(t)) for i, t in enumerate(texts)])


def test_split_is_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    r = random.Random(3)
    alphabet = "ab1 '\n\t.!éΣ中२  ́stdmlrve"
    texts = [t or "" for t in odd_texts()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    codes, cuts, counts = byte_bpe.split_words(texts)
    stops = np.append(cuts[1:], len(codes.points))
    words = [codes.text[a:b] for a, b in zip(cuts, stops)]
    at = 0
    for text, n in zip(texts, counts):
        assert words[at : at + n] == pattern.findall(text), text
        at += n


def test_long_words(spark, ranks, plain):
    r = random.Random(5)
    words = ["a" * 5000, "abc" * 700, "=" * 3001, "".join(r.choice("ABCDEFabcdef") for _ in range(5000)), "".join(r.choice("thinger") for _ in range(1200)), "中文字" * 300]
    words += ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 300))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id int, text string")
    got = dict(byte_bpe.encode(docs, ranks).select("doc_id", "ids").collect())
    for i, w in enumerate(words):
        assert got[i] == plain.encode_ordinary(w), w[:50]


def test_tokens_that_merges_do_not_give(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"xyz": 258}
    assert byte_bpe.unreachable(ranks) == [b"xyz"]
    plain = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz", "xyz xyzz", "abc xyz,xyz", "abcabc bc xy"]
    got = dict(byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ranks).select("doc_id", "ids").collect())
    assert [got[i] for i in range(len(texts))] == [plain.encode_ordinary(t) for t in texts]


def test_decoding_long_lists(spark, ranks):
    r = random.Random(6)
    ids = [[r.randrange(len(ranks)) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4096, 4097, 9000)] + [None, [5, 10_000_000, 6]]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id int, ids array<int>")
    by = {v: k for k, v in ranks.items()}
    for i, raw in byte_bpe.decode(rows, ranks).select("doc_id", "decoded").collect():
        assert raw is None if ids[i] is None else bytes(raw) == b"".join(by.get(t, b"") for t in ids[i])
