import random

import public_tokenizers
import pytest
from conftest import TESTDATA
from odd import empty_documents, odd_documents
from tokenizers import Tokenizer, models

from sylvaframe.llm import token_counts
from sylvaframe.llm.queries import op7_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def marked(text):
    return "▁" + text.replace(" ", "▁") if text else ""


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def plain(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))
    return lambda text: len(t.encode(marked(text), add_special_tokens=False).ids) if text else 0


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in op7_token_counts(spark, f"{TESTDATA}/sf0.001").collect()}
    assert got == {r.doc_id: plain(r.text or "") for r in docs}


def test_odd_rows(spark, vocabulary, plain):
    docs, rows = odd_documents(spark)
    got = token_counts.token_counts(docs, vocabulary).collect()
    assert sorted(((r.doc_id is not None, r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((d is not None, d, plain(t)) for d, t in rows), key=str)
    assert token_counts.token_counts(empty_documents(spark), vocabulary).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknowns(fallback):
    """Small vocabularies with equal scores, unknown characters and marks inside pieces."""
    r = random.Random(6)
    for trial in range(60):
        pieces = {"<unk>": 0.0}
        if fallback:
            pieces.update({f"<0x{b:02X}>": -9.0 for b in range(256)})
        for _ in range(r.randint(3, 25)):
            pieces["".join(r.choice("abcé▁") for _ in range(r.randint(1, 4)))] = -float(r.randint(1, 4))
        vocabulary = list(pieces.items())
        plain = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=fallback))
        counter = token_counts.Counter(vocabulary, fallback)
        texts = ["".join(r.choice("abcéz 中") for _ in range(r.randint(0, 25))) for _ in range(40)]
        counts, _ = counter(texts)
        want = [len(plain.encode(marked(t), add_special_tokens=False).ids) if t else 0 for t in texts]
        assert counts.tolist() == want, trial


def test_scores_are_the_best_of_all_paths():
    r = random.Random(9)

    def paths(word, known):
        if not word:
            yield 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in known:
                for rest in paths(word[n:], known):
                    yield known[word[:n]] + rest

    for _ in range(30):
        known = {p: -float(r.randint(1, 9)) for p in ["▁", "a", "b", "c", *("".join(r.choice("abc▁") for _ in range(r.randint(2, 4))) for _ in range(15))]}
        counter = token_counts.Counter(list(known.items()), False)
        texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 9))) for _ in range(20)]
        _, scores = counter(texts)
        assert scores.tolist() == [max(paths(marked(t), known)) for t in texts]
