"""Licence scan with a positional rare-token index.

A template is a licence notice with phrases that must stand in it. The corpus is read once to count
in how many documents each licence word occurs. Of each template, the rarest words inside its
mandatory phrases (highest IDF) enter the index with their positions. A second pass finds these
words in every file, turns each hit into the position where the template would begin, keeps the
beginnings that all rare words of the template agree on, and verifies the mandatory phrases word by
word. As the rare words lie inside phrases that must match, no place is missed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased: ASCII digits and
letters and everything beyond ASCII, so they are found on the UTF-8 bytes. Null and empty texts have
no words, no places, empty labels and score 0. Rows are scanned one by one: equal or null ids do no
harm, and other columns are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]
    base: bool = False


#: Phrases whose places are all counted (fixed values).
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Public licence notices and the phrases that must stand in them (fixed values).
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "software and associated documentation files")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Words:
    """The words of some texts: bytes, bounds, and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n" * 9
        self.bytes = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = _WORD_BYTE[self.bytes]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.keys = np.zeros(len(self.starts), np.uint64)
        for k in range(8):
            self.keys |= self.bytes[self.starts + k].astype(np.uint64) << np.uint64(8 * k)
        self.keys &= _MASKS[np.minimum(self.stops - self.starts, 8)]

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.stops[i]].tobytes()

    def hits(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are in the vocabulary, and which they are."""
        key = np.array([int.from_bytes(w[:8], "little") for w in vocabulary], np.uint64)
        order = np.argsort(key, kind="stable")
        near = np.minimum(np.searchsorted(key[order], self.keys), len(key) - 1)
        at = np.flatnonzero(key[order][near] == self.keys)
        out_at, out_word = [], []
        size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        for v in range(len(vocabulary)):
            same = at[(self.keys[at] == key[v]) & (self.stops[at] - self.starts[at] == size[v])]
            if size[v] > 8 and len(same):
                same = same[[self.word(i) == vocabulary[v] for i in same]]
            out_at.append(same)
            out_word.append(np.full(len(same), v))
        return np.concatenate(out_at), np.concatenate(out_word)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def word_idf(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """IDF over all documents of a fixed vocabulary; what comes to the driver is one number a word."""
    vocabulary = [w.encode() for w in words]

    def count(batch):
        found = Words(_texts(batch))
        at, word = found.hits(vocabulary)
        doc = np.searchsorted(found.first, at, side="right")
        seen = np.unique(doc.astype(np.int64) * len(vocabulary) + word)
        df = np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        yield {"word": [-1, *range(len(vocabulary))], "df": [batch.num_rows, *df.tolist()]}

    counts = arrow_rows(id_text(docs, id_col, text_col), "word int, df bigint", count).groupBy("word").agg(F.sum("df").alias("df"))
    df = {r.word: r.df for r in counts.collect()}
    return {w: float(np.log((df.get(-1, 0) + 1) / (df.get(i, 0) + 1))) + 1e-3 for i, w in enumerate(words)}


@dataclass(frozen=True)
class Index:
    """Postings of the rare words: word -> (template, its position); how many words a template must be hit by."""

    words: list[bytes]
    postings: list[list[tuple[int, int]]]
    needed: list[int]
    idf: dict[str, float]


def build_index(templates: tuple[Template, ...], idf: dict[str, float], rare_words: int = 2) -> Index:
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    needed = []
    for t, template in enumerate(templates):
        words = template.text.split()
        inside = sorted({i for a, b in _spans(template) for i in range(a, b)}, key=lambda i: (-idf[words[i]], i))[:rare_words]
        needed.append(len(inside))
        for i in inside:
            postings[words[i]].append((t, i))
    names = sorted(postings)
    return Index([w.encode() for w in names], [postings[w] for w in names], needed, idf)


def _spans(template: Template) -> list[tuple[int, int]]:
    words, out = template.text.split(), []
    for phrase in template.mandatory:
        p = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
        out.append((at, at + len(p)))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words`` and ``matches``, an array of structs
    (label, base, start, words, score), one for each verified place of each template, by start."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    idf = word_idf(docs, vocabulary, id_col, text_col)
    index = build_index(templates, idf, rare_words)
    texts = [[w.encode() for w in t.text.split()] for t in templates]
    spans = [_spans(t) for t in templates]
    weights = [np.array([idf[w] for w in t.text.split()]) for t in templates]
    src = id_text(docs, id_col, text_col)
    kind = dict(src.dtypes)["doc_id"]

    def find(batch):
        found = Words(_texts(batch))
        at, word = found.hits(index.words)
        doc = np.searchsorted(found.first, at, side="right") - 1
        votes: dict[tuple[int, int, int], int] = defaultdict(int)
        for i, w, d in zip(at.tolist(), word.tolist(), doc.tolist()):
            for t, place in index.postings[w]:
                votes[d, t, i - place] += 1
        matches: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for (d, t, begin), n in votes.items():
            low, high = found.first[d], found.first[d + 1]
            if n < index.needed[t] or any(begin + a < low or begin + b > high or any(found.word(begin + i) != texts[t][i] for i in range(a, b)) for a, b in spans[t]):
                continue
            same = np.array([low <= begin + i < high and found.word(begin + i) == w for i, w in enumerate(texts[t])])
            a = spans[t][0][0]
            matches[d].append({"label": templates[t].label, "base": templates[t].base, "start": int(begin + a - low), "words": len(texts[t]), "score": float(weights[t][same].sum() / weights[t].sum())})
        for row in matches:
            row.sort(key=lambda m: (m["start"], m["label"], not m["base"], m["words"]))
        yield {"doc_id": batch.column("doc_id"), "n_words": np.diff(found.first), "matches": matches}

    return arrow_rows(src, f"doc_id {kind}, n_words bigint, matches array<struct<label:string,base:boolean,start:bigint,words:int,score:double>>", find)


def summary(scanned: DataFrame) -> DataFrame:
    """``scan`` as one flat row per document; the columns n_base to base_labels speak of the base phrases."""
    base = F.filter("matches", lambda m: m.base)

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.label))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m.start)).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m.start)).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0)).alias("score"),
    )
