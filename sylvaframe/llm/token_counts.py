"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists, for each place in a word, every vocabulary piece that ends there; a Viterbi
pass carries only the best score and the number of pieces on the best path. Rules of the tokenizers library's
Unigram model: a path replaces another to the same place only if its score is strictly greater, and paths
come in order of where their last piece begins; a character that is no piece costs the least score less 10; such
characters in a row are one unknown token, or one token for each of their UTF-8 bytes where the vocabulary has
them all as ``<0xNN>``.

Spaces become the mark U+2581 and one mark goes before a text that is not empty. Where no piece has a mark behind
another character and the mark is a piece, the best path of a text is that of its words (marks and what follows
them), so each distinct word is solved once per Python worker; with other vocabularies a text is one word. Null and empty
texts have no tokens and score 0. Rows are counted one by one; other columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import Codes, arrow_rows, distinct_spans, id_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1_000_000


def load_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Pieces on the best path of a word, and its score."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(float(s) for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.singles = {p for p in pieces if len(p) == 1}
        # an unknown mark would join unknown characters of two words
        self.by_word = (self.bytes or MARK in self.singles) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.known: dict[str, int] = {}
        self.counts: list[int] = []
        self.scores: list[float] = []

    def solve(self, word: str) -> tuple[int, float]:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best = None
            for size, gain in sorted(ends[end], reverse=True):  # the longest begins first
                start = end + 1 - size
                total = score[start] + gain
                if best is None or total > best:
                    best, count[end + 1] = total, count[start] + 1
            if word[end] not in self.singles:
                total = score[end] + self.unknown
                if best is None or total > best:
                    best, unknown[end + 1] = total, True
                    more = len(word[end].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end])
                    count[end + 1] = count[end] + more
            score[end + 1] = best
        return count[n], score[n]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known, self.counts, self.scores = {}, [], []
        codes = Codes([MARK + t.replace(" ", MARK) if t else "" for t in texts])
        first, last, ends = self.words(codes)
        one, which = distinct_spans(codes.points, first, last)
        words = [codes.text[a:b] for a, b in zip(first[one].tolist(), last[one].tolist())]
        for w in words:
            if w not in self.known:
                c, s = self.solve(w)
                self.known[w] = len(self.counts)
                self.counts.append(c)
                self.scores.append(s)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        out = []
        for values in (np.array(self.counts, np.int64), np.array(self.scores, np.float64)):
            total = np.concatenate([[0], np.cumsum(values[code][which] if len(code) else np.zeros(0))])
            out.append(np.diff(total[np.concatenate([[0], ends])]))
        return out[0].astype(np.int64), out[1]

    def words(self, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word begins and ends, and the number of words up to the end of each text."""
        n = len(codes.points)
        new = np.zeros(n + 1, bool)
        new[0] = n > 0
        new[codes.ends[codes.ends < n]] = True
        if self.by_word:
            mark = codes.points == ord(MARK)
            new[1:n] |= mark[1:] & ~mark[:-1]
        first = np.flatnonzero(new[:n])
        return first, np.append(first[1:], n)[: len(first)], np.searchsorted(first, codes.ends)


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score``, the sum of the scores on the best path, of every row."""
    src = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_fallback))  # bounded by the vocabulary
    number = hash((tuple(vocabulary), byte_fallback))

    def count(batch):
        if number not in _counters:
            _counters.clear()
            _counters[number] = Counter(*shared.value)
        n, score = _counters[number](batch.column("text").to_pylist())
        yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "score": score}

    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens bigint, score double", count)
