import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import TESTDATA
from odd import empty_documents, odd_documents, odd_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sylvaframe.llm import packing
from sylvaframe.llm.queries import op6_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


#: Characters that the library's older tables take otherwise.
KNOWN_DIFFERENCES = 0


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def cut(tokenizer, rows):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            out.append((doc, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def best_fit(lengths, capacity):
    """Longest first, each into the fullest sequence that has room."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def gapless(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()
    rows = op6_packing(spark, f"{TESTDATA}/sf0.01").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(cut(tokenizer, [(r.doc_id, r.text or "") for r in docs]))
    assert gapless(rows, 2048) == best_fit([r.length for r in rows], 2048)


def test_odd_rows(spark, tokenizer):
    docs, rows = odd_documents(spark)
    got = packing.packed_documents(docs, PATH).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(cut(tokenizer, rows), key=key)
    gapless(got, 2048)
    assert packing.packed_documents(empty_documents(spark), PATH).count() == 0


def test_ids_of_sequences(spark, tokenizer):
    docs, rows = odd_documents(spark, [t for t in odd_texts() if t][:20])
    packed = packing.pack(packing.pieces(docs, PATH, capacity=64), 64)
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    sizes = [r.n for r in packing.sequences(packed).select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == total and max(sizes) <= 64


def test_sweep_is_best_fit():
    r = random.Random(2)
    for _ in range(150):
        capacity = r.randint(3, 60)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.sweep(counts, capacity)
        assert sum(runs[:, 2]) == len(lengths)
        used = {}
        for length, _, many, first, offset in runs.tolist():
            for s in range(first, first + many):
                used.setdefault(s, []).append((offset, length))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == best_fit(lengths, capacity)


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    table = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.when(F.col("id") % 3 == 0, 5).otherwise(3)).cast("bigint").alias("length"))
    rows = packing.pack(table, 8).collect()
    assert len(rows) == 500 and gapless(rows, 8) == best_fit([r.length for r in rows], 8)


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    import json

    file = json.load(open(PATH, encoding="utf-8"))
    file["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalise"):
        packing.pieces(empty_documents(spark), str(other))


def test_every_character_is_normalised_and_classed_as_in_the_library(tokenizer):
    """Python's and the library's tables of characters, compared on every assigned one between two letters."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = [f"a{c}b {c}" for c in chars]
    ids = packing.WordIds(PATH)
    differing = []
    for a in range(0, len(texts), 20_000):
        part = texts[a : a + 20_000]
        codes, first, last, counts = packing.split_words(part)
        got, n = ids(codes, first, last)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        for i, e in enumerate(tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            if got[ends[i] : ends[i + 1]].tolist() != e.ids:
                differing.append(part[i][1])
    assert len(differing) <= KNOWN_DIFFERENCES, (len(differing), [f"U+{ord(c):04X}" for c in differing[:40]])
