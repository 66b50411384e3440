"""SimHash near-duplicates, found with keys of the binary Golay code.

A fingerprint has four segments of 16 bits. Two fingerprints that differ in at most three bits agree
in two segments at least, or agree in one and differ in exactly one bit of each other. So they share one
of these keys: the values of two segments, or the value of one segment with the index of a Golay codeword
near the next. A segment, padded to 23 bits, gets the codewords at distance 4 or less (one to six): the
code is perfect with radius 3, so the codeword nearest to one of two words at distance 1 is at distance 4
or less of the other. A join on the keys finds all candidates; each is verified on all 64 bits.

Equal fingerprints are one node, so copies never meet each other. The members of a key are joined with each
other, and only verified links leave the join. The members of a key with more than ``CROWD`` are keyed anew by what the key leaves
open: its other bits are cut into five parts, and as at most three of these can differ, two are equal in any linked pair. So each member gets
ten keys that hold two of the parts, too. What is still crowded is keyed again, until a group has at most ``FOREST`` members;
each such group gives a spanning forest of its links. So a crowd of n emits a small multiple of n rows for each round, not n^2,
and the components stay exact.

Null and empty texts have fingerprint zero and link like any other. Rows are taken one by one: equal
ids are rows of their own, and null ids are linked but never name a component (a component
without other ids has a null one). Other columns are not carried. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, ranges, stored
from .components import connected_components

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
DISTANCE = 3
CROWD = 256
#: Members of a group that one task compares with each other: all values of 12 open bits.
FOREST = 1 << 12


_golay: list = []


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of 23 bits the indices (the upper 12 bits) of the codewords at distance 4 or less, as (indices, first, size)."""
    if not _golay:
        from itertools import combinations

        def remainder(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GOLAY << (k - 11)
            return x

        errors: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                errors[remainder(e)].append(e)
        size = np.fromiter(map(len, errors), np.int64, len(errors))
        _golay.extend([np.array([remainder(1 << b) for b in range(23)], np.int64), np.concatenate([np.array(e, np.int64) for e in errors]), np.cumsum(size) - size, size])
    place, errors, first, size = _golay
    syndrome = np.zeros(len(words), np.int64)
    for b in range(23):
        syndrome ^= np.where(words >> b & 1, place[b], 0)
    n = size[syndrome]
    return (np.repeat(words, n) ^ errors[ranges(first[syndrome], n)]) >> 11, np.cumsum(n) - n, n


def segment_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of 64-bit fingerprints: (row, key). The upper bits of a key tell its kind."""
    seg = [((fingerprints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    every = np.arange(len(fingerprints))
    rows, keys, kind = [], [], 0
    for a in range(4):
        for b in range(a + 1, 4):
            rows.append(every)
            keys.append((kind << 40) | (seg[a] << 16) | seg[b])
            kind += 1
    for a in range(4):
        near, _, n = near_codewords(seg[(a + 1) % 4])
        rows.append(np.repeat(every, n))
        keys.append((kind << 40) | (np.repeat(seg[a], n) << 12) | near)
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def simhash(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text: bit by bit the majority of the XXH64 of its word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = []
    for text in texts:
        words = text.lower().split()  # on bytes: ASCII only
        n = len(words)
        if n <= shingle:
            counts.append(int(n > 0))
            if n:
                hashes.append(digest(b" ".join(words), 42))
            continue
        plain = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size + 1) - size - 1
        stop = start + size
        hashes += [digest(plain[a:b], 42) for a, b in zip(start[: n - shingle + 1].tolist(), stop[shingle - 1 :].tolist())]
        counts.append(n - shingle + 1)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp`` (the 64 bits as bigint) of every row."""
    src = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))

    def run(batch):
        yield {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "fp": simhash(batch.column("text").cast(pa.binary()).to_pylist(), shingle).view(np.int64)}

    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, mark bigint, fp bigint", run)


def _keyed(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for a in range(0, len(fp), 20_000):
            row, key = segment_keys(fp[a : a + 20_000].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[a : a + 20_000][row])], ["key", "fp"])


def kind_masks() -> list[int]:
    """The bits that all members of a key of each kind have in common."""
    segment = [0xFFFF << (16 * k) for k in range(4)]
    masks = [segment[a] | segment[b] for a in range(4) for b in range(a + 1, 4)] + segment
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def finer_masks(mask: int) -> list[int]:
    """``mask`` with two of five parts of the other bits, for every two."""
    from itertools import combinations

    open_ = [1 << b for b in range(64) if not mask >> b & 1]
    parts = [sum(open_[i::5]) for i in range(5)]
    return [mask | a | b for a, b in combinations(parts, 2)]


def _finer(batches):
    """Rows (mask, fp) by all finer masks."""
    for batch in batches:
        mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for m in np.unique(mask):
            mine = fp[mask == m]
            finer = np.array(finer_masks(int(m) % (1 << 64)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(finer, len(mine))), pa.array(np.tile(mine, len(finer)))], ["mask", "fp"])


def _forest(table: pa.Table) -> pa.Table:
    """A spanning forest of the links among the fingerprints of a group."""
    fp = np.unique(table["fp"].to_numpy()).view(np.uint64)
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= DISTANCE
            new, left = left[near], left[~near]
            a += [i] * len(new)
            b += new.tolist()
            front += new.tolist()
    signed = fp.view(np.int64)
    return pa.table({"a": signed[np.array(a, np.int64)], "b": signed[np.array(b, np.int64)]})


def links(distinct: DataFrame, crowd: int = CROWD, forest: int = FOREST) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``distinct`` (column fp, each once) that differ in at most
    three bits: all of them, but of crowded keys only as many as connect what is connected."""
    keyed = stored(distinct.select("fp").mapInArrow(_keyed, "key bigint, fp bigint"), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "shared-keys")
    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    found = x.join(y, (x["key"] == y["key"]) & (x["a"] < y["b"]) & (F.bit_count(x["a"].bitwiseXOR(y["b"])) <= DISTANCE)).select("a", "b")
    left = many.select(F.get(F.array(*map(F.lit, kind_masks())), F.shiftright("key", 40).cast("int")).alias("mask"), "fp").distinct()
    while not left.isEmpty():
        finer = stored(left.mapInArrow(_finer, "mask bigint, fp bigint").distinct().withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "finer-keys")
        sizes = finer.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(finer.join(sizes, ["mask", "value"]), "finer-shared")
        small = F.col("n") <= forest
        found = found.union(shared.where(small).select("mask", "value", "fp").groupBy("mask", "value").applyInArrow(_forest, "a bigint, b bigint"))
        left = shared.where(~small).select("mask", "fp").distinct()
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``fp``, ``root`` (the component) and ``component_id``, the least id that links can reach, of every row."""
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(names, "root"), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def first_rows(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that come first in their class.

    ``classes`` has doc_id, mark (the hash of the text) and class of every row. The row with the least id comes first, of several texts with
    this id the one with the least mark; of rows that are equal in id and text (null: empty) any one stays. Rows without an id stay.
    """
    named = classes.where("doc_id is not null").groupBy("class", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    keys = stored(named.join(first, "class").select("doc_id", "mark", "n", (F.col("first") == F.struct("doc_id", "mark")).alias("stays")), "first-rows")
    gone = keys.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_gone_mark"))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    rest = docs.join(gone, (docs[id_col] == gone["_gone"]) & (mark == gone["_gone_mark"]), "left_anti")
    if keys.where("stays and n > 1").isEmpty():
        return rest
    named = rest.where(F.col(id_col).isNotNull()).withColumn("_mark_of_text", F.coalesce(F.col(text_col), F.lit("")))
    return named.dropDuplicates([id_col, "_mark_of_text"]).drop("_mark_of_text").union(rest.where(F.col(id_col).isNull()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that come first in their component (see ``first_rows``)."""
    return first_rows(docs, near_duplicates(docs, id_col, text_col, shingle).withColumnRenamed("root", "class"), id_col, text_col)
