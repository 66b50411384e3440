"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

``pieces`` tokenises every document, adds the closing id and cuts what is longer than a sequence.
``pack`` then takes the lengths from the longest down. As sizes are whole numbers up to the capacity, documents and gaps, sorted by size, are lists of
runs: so many documents of a length, so many open sequences with a gap. The run of gaps with the smallest sufficient size is the successor of the documents of a length. Which document
gets which gap is resolved by rank: the k-th document of the run goes to the k-th gap. The gaps shrink and the step repeats until the
run is placed, new sequences are opened where no gap suffices, and the next length follows.

This sweep runs once, on the driver, over the counts of at most ``capacity`` lengths; its result has a row for each part of a run and place in a
sequence, and their number depends on the lengths that occur, not on the number of documents. Tokenising, the ranks of the documents, and the
assignment of every document by its rank are distributed. A length that very many documents share is split into buckets for its ranks.

Null and empty texts are one closing id. Rows that repeat an id, or have none, are packed one by one. Other
columns are not carried. No rows give no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Codes, arrow_rows, contractions, distinct_spans, id_text, stored

CAPACITY = 2048
CLOSING_ID = 0
#: What ends the last piece of a word (fixed value).
WORD_END = "</w>"
#: How the tokenizer's file must normalise and split (fixed values): what ``split_words`` does.
NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Pieces of one length that are ranked together.
RANKED = 200_000


def split_words(texts: list[str]) -> tuple[Codes, np.ndarray, np.ndarray, np.ndarray]:
    """The words (code points, where each begins and ends) that the tokenizer's normalizer and splitter make of each text, and their number in each: NFC and lower case, then
    letters in a row, single numbers, other characters in a row, contractions cut off, white space dropped."""
    lowered = [(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("Σ", "σ").lower() for t in texts]
    codes = Codes(lowered)
    n = len(codes.points)
    if not n:
        none = np.zeros(0, np.int64)
        return codes, none, none, np.zeros(len(texts), np.int64)
    starts = codes.runs()
    mask = np.zeros(n + 1, bool)
    mask[starts] = True
    mask[:n] |= codes.kind == Codes.NUMBER
    stops = np.append(starts[1:], n)
    at, taken = contractions(codes, starts, np.ones(len(starts), bool))
    mask[stops[at]] = False
    mask[stops[at] + taken] = True
    cuts = np.flatnonzero(mask[:n])
    ends = np.append(cuts[1:], n)
    word = codes.kind[cuts] != Codes.SPACE
    first, last = cuts[word], ends[word]
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], codes.ends])))
    return codes, first, last, counts


def check_file(path: str) -> None:
    """Raises an error if the tokenizer's file normalises or splits in another way."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = [(n.get("type"), n.get("pattern", {}).get("Regex")) for n in (file.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (file.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
    level = [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest]
    if steps != NORMALIZER or split.get("pattern") != {"Regex": SPLIT} or not split.get("invert") or split.get("behavior") != "Removed" or level != [("ByteLevel", False, False)]:
        raise ValueError(f"{path} does not normalise and split as this operator does")
    if file["model"].get("end_of_word_suffix") != WORD_END:
        raise ValueError(f"words of {path} do not end in {WORD_END}")


class WordIds:
    """Ids of words by a tokenizer file, each word tokenised once while it is remembered.

    The words come normalised and split, so only the byte mapping and the merges of the tokenizer are left to do.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, words: list[str]):
        # all words as one text that is split already: an id of a word's end closes each
        ids = np.array(self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(words) or len(ids) and not self.closing[ids[-1]]:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, ends = np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum(list(map(len, lists))) - 1
        size = np.diff(ends, prepend=-1)
        n, total = len(self.known), len(ids)
        while n + len(words) > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        self.size[n : n + len(words)] = size
        self.first[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def __call__(self, codes: Codes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of ids of each word."""
        if len(self.known) > REMEMBERED:
            self.forget()
        one, which = distinct_spans(codes.points, first, last)
        text = codes.text
        words = [text[a:b] for a, b in zip(first[one].tolist(), last[one].tolist())]
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[which]
        n = self.size[code]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.first[code] - (ends - n), n) + np.arange(n.sum())], n


_tokenizers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` of every piece of every document."""
    check_file(tokenizer_path)
    src = id_text(docs, id_col, text_col)

    def cut(batch):
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordIds(tokenizer_path)
        codes, first, last, counts = split_words(batch.column("text").to_pylist())
        ids, n = _tokenizers[tokenizer_path](codes, first, last)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        where = np.repeat(np.arange(batch.num_rows), np.diff(np.concatenate([[0], ends])))
        full = np.empty(len(ids) + batch.num_rows, "<u4")
        closing = ends + np.arange(batch.num_rows)
        full[np.arange(len(ids)) + where] = ids
        full[closing] = closing_id
        begins = np.concatenate([[0], closing[:-1] + 1])
        sizes = closing + 1 - begins
        many = -(-sizes // capacity)
        owner = np.repeat(np.arange(batch.num_rows), many)
        piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(sizes[owner] - start, capacity)
        at = begins[owner] + start
        raw = full.tobytes()
        out = {
            "doc_id": batch.column("doc_id").take(pa.array(owner)),
            "piece": piece,
            "start": start,
            "length": length,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())],
        }
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(full)), pa.int32()), pa.array(full.astype(np.int32)))
        yield out

    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint{', ids array<int>' if with_ids else ''}", cut)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placement of runs: rows (length, first rank, number, first sequence, offset), in order of length and rank."""
    gaps: list[int] = []  # sizes of open gaps, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    placed, sequences = [], 0

    def put(gap, first, number):
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, number = capacity, sequences, left
            fit = gap // length
            use = min(number, -(-left // fit))
            # best fit fills one sequence before it takes the next, so only the last of them may hold fewer
            full = use if use * fit <= left else use - 1
            rest = min(left, use * fit) - full * fit
            if gap == capacity:
                sequences += use
            else:
                put(gap, first + use, number - use)
            for k in range(fit):  # the k-th document of each of these sequences
                now = full + (k < rest)
                if now:
                    placed.append((length, rank, now, first, capacity - gap + k * length))
                rank, left = rank + now, left - now
            put(gap - fit * length, first, full)
            put(gap - rest * length, first + full, use - full)
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (columns doc_id, piece and length, and others) with ``sequence_id`` and ``offset`` of every row."""
    spark = table.sparkSession
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each size
    placed = sweep(counts, capacity)
    shared = spark.sparkContext.broadcast(placed)
    buckets = max(8, sum(counts.values()) // RANKED)
    rows = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("_rank", inside.cast("bigint") - 1).join(before, ["length", "_bucket"]).select(*table.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    names = table.columns
    at, rank_at = names.index("length"), len(names)

    def assign(batches):
        runs = shared.value
        key = (runs[:, 0] << 40) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(rank_at).to_numpy()
            run = runs[np.searchsorted(key, (length << 40) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document (without its ids) with its sequence and place; the texts are tokenised once."""
    cut = pieces(docs, tokenizer_path, capacity, closing_id, id_col, text_col, with_ids=False)
    return pack(stored(cut, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every sequence, from packed pieces that carry their ``ids``."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
