"""Byte-level BPE: ranked merges folded over the distinct words of a block of documents.

A task splits its texts into words with numpy and gathers blocks of about ``BLOCK_BYTES`` of text; a block
row holds its distinct words once, as arrays of their bytes' ids and of the ranks of neighbours, and each document as word numbers. Spark's higher-order
functions fold the merges over every distinct word: a step merges the leftmost place of the pair with the lowest rank, in long words all its places from the left. Ranks
come from a constant rank map of integers: of every two tokens that together are a token. A last step expands
the word numbers into token ids. No text is shuffled, and a lost executor costs only its own splits.

Words that many tasks meet are folded once for all: a first pass counts words over the corpus, the
most frequent ones (at most ``FREQUENT``) go through the same fold, and their ids reach the
tasks as one broadcast of bounded size. All other words are folded where their block is.

A word is cut where no token of the vocabulary can reach across, judged by the two and three bytes around
the place; its parts are then words of their own. So long words cost little more than their length, whatever it is.

Null and empty texts give no ids; rows with equal or null ids are encoded row by row; other
columns are not carried.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Codes, contractions, differing, distinct_spans, id_text, ranges, span_hashes, stored, stretches, text_chunks

BLOCK_BYTES = 8 << 20
#: The most words whose ids are shared by all tasks (about 50 bytes each).
FREQUENT = 600_000
#: Words that a task counts before it sends their numbers on.
COUNTED = 150_000
#: Tokens of a word above which a step merges all places of the lowest pair, not the first.
MANY = 64
#: Length of a word from which it is merged in turns, and the steps of the first ones: a run of one letter takes few steps, whatever its length.
LONG, TURNS = 256, (64, 4096)
#: Ids are below LIMIT, two of them make a pair's key; NONE is no id and no rank.
LIMIT = NONE = 131_071


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_words(texts: list[str]) -> tuple[Codes, np.ndarray, np.ndarray]:
    """Every match of the split pattern in all texts, in order: the code points, where each begins, and the number of words of each text.
    A word ends where the next begins.

    Runs of one class of character are found with numpy; a single space joins the run behind it,
    other white space before a word stays on its own, and contractions are cut off.
    """
    codes = Codes(texts)
    n = len(codes.points)
    if not n:
        return codes, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    starts = codes.runs()
    stops = np.append(starts[1:], n)
    kind = codes.kind[starts]
    ends_text = np.isin(stops, codes.ends)
    mask = np.zeros(n + 1, bool)
    mask[starts] = True
    spaced = np.flatnonzero((kind == Codes.SPACE) & ~ends_text)
    mask[stops[spaced] - 1] = True
    joined = spaced[codes.points[stops[spaced] - 1] == 32]
    mask[stops[joined]] = False
    free = np.ones(len(starts), bool)
    free[joined + 1] = False
    at, taken = contractions(codes, starts, free)
    mask[stops[at]] = False
    mask[stops[at] + taken] = True
    cuts = np.flatnonzero(mask[:n])
    counts = np.diff(np.searchsorted(cuts, np.concatenate([[0], codes.ends])))
    return codes, cuts, counts


class Joints:
    """Where a token of the vocabulary may reach from one byte to the next."""

    def __init__(self, ranks: dict[bytes, int]):
        self.two, three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        raw = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int32)
        size = np.fromiter(map(len, ranks), np.int64, len(ranks))
        first = np.cumsum(size) - size
        at = first[size == 2]
        self.two[raw[at] << 8 | raw[at + 1]] = True
        at = ranges(first[size > 2], size[size > 2] - 2)
        three[raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]] = True
        self.three = np.packbits(three, bitorder="little")

    def cuts(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """All places where a part of a word begins, of bytes and the places where words begin."""
        new = np.zeros(len(raw) + 2, bool)
        new[begins] = new[len(raw) :] = True
        b = raw.astype(np.int32)
        reach = self.two[b[:-1] << 8 | b[1:]]  # from i to i + 1
        key = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        long = (self.three[key >> 3] >> (key & 7).astype(np.uint8) & 1).astype(bool)  # from i to i + 2
        inside = ~new[1 : len(raw)]
        reach[1:] |= long & inside[:-1]
        reach[:-1] |= long & inside[1:]
        new[1 : len(raw)] |= ~reach
        return np.flatnonzero(new[: len(raw)])


def unreachable(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens that the merges of their own bytes do not give: they are found as whole words only."""
    out = []
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, i = min((ranks.get(a + b, LIMIT), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == LIMIT:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) > 1:
            out.append(token)
    return out


class RankMap:
    """A perfect hash map of the keys of pairs to the rank of what they make, as two literal arrays.

    Keys of one group (the key modulo ``groups``) are moved by the same distance, so that all keys have a
    cell of their own; a cell holds key and rank.
    """

    BITS = 17  # of a rank
    EMPTY = 1 << 52

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * LIMIT + b] = rank
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.groups, self.size = len(keys) // 2 + 1, 2 * len(keys) + 1
        group = keys % self.groups
        order, size = np.argsort(group, kind="stable"), np.bincount(group, minlength=self.groups)
        first = np.cumsum(size) - size
        free, self.moves, self.cells = np.ones(self.size, bool), np.zeros(self.groups, np.int64), np.full(self.size, self.EMPTY)
        for g in np.argsort(-size, kind="stable").tolist():
            mine = order[first[g] : first[g] + size[g]]
            move = 0
            while not (free[at := (keys[mine] + move) % self.size].all() and len(set(at.tolist())) == len(at)):
                move += 1
            free[at], self.moves[g], self.cells[at] = False, move, keys[mine] << self.BITS | values[mine]

        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full(1 << 16, NONE, np.int64)  # of two bytes the rank and the first one's id
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
        self.first = self.first << self.BITS | np.repeat(byte_ids, 256)
        self.last = NONE << self.BITS | byte_ids

    def constant(self, spark: SparkSession) -> Column:
        return constant(spark, cells=self.cells, moves=self.moves)

    def start(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.ListArray:
        """Words of bytes as the fold takes them: a mark, a number for each byte (the rank of its pair with the next, and its id), a mark."""
        ends = np.cumsum(size + 2)
        out = np.full(ends[-1] if len(ends) else 0, NONE << self.BITS | NONE, np.int64)
        for s in stretches(size):
            n = size[s]
            b = raw[ranges(first[s], n)].astype(np.int32)
            out[ranges(ends[s] - n - 1, n)] = self.first[b << 8 | np.append(b[1:], 0)]
            out[ends[s] - 2] = self.last[b[np.cumsum(n) - 1]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))

    def rank(self, key: Column, table: Column) -> Column:
        """The rank of a pair, or NONE."""
        cell = F.get(table.cells, F.pmod(key + F.get(table.moves, F.pmod(key, F.lit(self.groups))), F.lit(self.size)))
        return F.least(cell.bitwiseXOR(F.shiftleft(key, self.BITS)), F.lit(NONE))


def constant(spark: SparkSession, **arrays) -> Column:
    """Arrays as the fields of one constant of a plan, to be a column of its own. It comes as a scalar from a table of one
    row, so that the texts of plans, which the driver keeps, don't spell it out."""
    row = pa.table({name: pa.array([a], pa.list_(pa.array(a).type)) for name, a in arrays.items()})
    return stored(spark.createDataFrame(row), "constant").select(F.struct(*arrays).alias("constant")).scalar()


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_ids(word: Column, ranks: RankMap, table: Column) -> Column:
    """Token ids (array<bigint>) of a word as ``RankMap.start`` gives it."""
    bits, one = RankMap.BITS, F.lit(1 << RankMap.BITS)

    def token(x):
        return x.bitwiseAND(F.lit(NONE))

    def rank(key):
        return ranks.rank(key, table)

    def without(array, change):
        """The array with changes by place, without what becomes null."""
        return F.filter(F.transform(array, change), lambda x: x.isNotNull())

    def first_place(parts, new, p):
        def joined(two):
            return without(
                parts,
                lambda x, i: F.when(i > p, x).when(i == p, F.lit(None)).when(i == p - 1, F.get(two, F.lit(1)) * one + new).when(i == p - 2, F.get(two, F.lit(0)) * one + token(x)).otherwise(x),
            )

        return _let(F.transform(F.array(token(F.get(parts, p - 2)) * F.lit(LIMIT) + new, new * F.lit(LIMIT) + token(F.get(parts, p + 1))), rank), joined)

    def every_place(parts, places, new):
        # the places as text, as one that touches the place merged before it is not merged
        marks = F.array_join(F.transform(places, lambda x: F.when(x == new, F.lit("1")).otherwise(F.lit("0"))), "")
        tokens = _let(
            F.split(F.replace(marks, F.lit("11"), F.lit("1-")), ""),
            lambda f: without(parts, lambda x, i: F.when(F.get(f, i) == "1", new).when(F.get(f, i - 1) == "1", F.lit(None)).otherwise(token(x))),
        )
        return _let(tokens, lambda t: F.transform(t, lambda x, i: rank(x * F.lit(LIMIT) + F.coalesce(F.get(t, i + 1), F.lit(NONE))) * one + x))

    def step(parts, _):
        def lowest(places, new):
            # both give the same; all places at once pay where a word has many
            many = F.size(parts) > MANY
            return F.when(new == NONE, parts).when(many, every_place(parts, places, new)).otherwise(_let(F.array_position(places, new).cast("int"), lambda p: first_place(parts, new, p)))

        return _let(F.transform(parts, lambda x: F.shiftright(x, bits)), lambda places: _let(F.array_min(places), lambda new: lowest(places, new)))

    def fold(parts, steps):
        return F.aggregate(steps, parts, step)

    def in_turns(parts, turns):
        # few steps first: those after the last merge would look at all that is left, each
        rest = F.sequence(F.lit(4), F.greatest(F.size(parts), F.lit(4)))
        if not turns:
            return fold(parts, rest)
        return _let(fold(parts, F.sequence(F.lit(1), F.lit(turns[0]))), lambda p: F.when(F.exists(p, lambda x: F.shiftright(x, bits) != NONE), in_turns(p, turns[1:])).otherwise(p))

    whole = F.when(F.size(word) > LONG, in_turns(word, TURNS)).otherwise(in_turns(word, ()))
    return F.filter(F.transform(whole, token), lambda x: x != NONE)


def _chunk_words(texts: list[str], joints: Joints | None):
    """The bytes of some texts, where each distinct word begins and ends in them, which of these each word is, and the number of words of each text."""
    codes, cuts, counts = split_words(texts)
    if not len(cuts):
        return np.zeros(0, np.uint8), cuts, cuts, cuts, counts
    p = codes.points
    width = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    raw = np.frombuffer(codes.text.encode(), np.uint8)
    first, ends = place[cuts], place[codes.ends]
    if joints is not None:
        first = joints.cuts(raw, first)
        counts = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
    last = np.append(first[1:], len(raw))
    one, which = distinct_spans(raw, first, last)
    return raw, first[one], last[one], which, counts


def frequent_words(src: DataFrame, joints, most: int = FREQUENT) -> DataFrame:
    """``word`` (binary) of the words with the highest counts in the column ``text``, at most ``most`` and none that
    occur once. ``joints`` is a broadcast."""

    def count(batches):
        seen: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for a, b in text_chunks(batch.column(0), CHUNK_BYTES // 2):
                raw, first, last, which, _ = _chunk_words(batch.column(0).slice(a, b - a).to_pylist(), joints.value)
                text = raw.tobytes()
                for x, y, k in zip(first.tolist(), last.tolist(), np.bincount(which, minlength=len(first)).tolist()):
                    w = text[x:y]
                    seen[w] = seen.get(w, 0) + k
                if len(seen) > COUNTED:
                    yield rows()
                    seen = {}
        yield rows()

    counted = stored(src.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word-counts")
    # the least count that keeps the number of words in bounds, found on the counts of counts
    level = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():  # at most 512 rows
        held += r.words
        if held > most:
            break
        least = r.n
    return counted.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


class Known:
    """Ids of frequent words in flat arrays, found by a hash of the word and then compared byte by byte."""

    def __init__(self, words: list[bytes], lists: list[list[int]] | pa.ListArray):
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        h = span_hashes(raw, np.cumsum(size) - size, np.cumsum(size))
        order = np.argsort(h, kind="stable")
        order = order[np.append(True, h[order[1:]] != h[order[:-1]])] if len(order) else order  # of two with one hash only one is known
        self.h, self.raw, self.begin, self.long = h[order], raw, (np.cumsum(size) - size)[order], size[order]
        lists = lists if isinstance(lists, pa.ListArray) else pa.array(lists, pa.list_(pa.int64()))
        many = lists.value_lengths().to_numpy().astype(np.int64)
        self.flat, self.first, self.size = lists.flatten().to_numpy().astype("<u4"), (np.cumsum(many) - many)[order], many[order]

    def find(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of the words, -1 where unknown."""
        if not len(self.h):
            return np.full(len(first), -1, np.int64)
        h = span_hashes(raw, first, last)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero((self.h[at] == h) & (self.long[at] == last - first))
        hit = hit[~differing(raw, first[hit], self.raw, self.begin[at[hit]], self.long[at[hit]])]
        out = np.full(len(first), -1, np.int64)
        out[hit] = at[hit]
        return out

    def lists(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[ranges(self.first[places], self.size[places])], self.size[places]


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``ids_bytes`` (the ids as little-endian unsigned 32-bit) of each row."""
    src = id_text(docs, id_col, text_col)
    kind = dict(src.dtypes)["doc_id"]
    context = docs.sparkSession.sparkContext
    pairs, alone = RankMap(ranks), unreachable(ranks)
    table = pairs.constant(docs.sparkSession)
    joints = context.broadcast(None if alone else Joints(ranks))  # 2 MB; words stay whole where a whole word may be a token that merges do not give

    def started(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pairs.start(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)], ["word", "start"])

    often = frequent_words(src, joints, frequent).repartition(max(8, context.defaultParallelism), "word").mapInArrow(started, "word binary, start array<bigint>")
    found = often.withColumn("_ranks", table).select("word", merged_ids(F.col("start"), pairs, F.col("_ranks")).alias("ids")).toArrow()  # at most ``frequent`` words
    ids = found["ids"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int64()))
    single = pa.array([[ranks[w]] for w in alone], pa.list_(pa.int64()))
    shared = context.broadcast(Known([*alone, *found["word"].to_pylist()], pa.concat_arrays([single, ids.cast(single.type)])))  # bounded by ``frequent`` and the vocabulary

    def pack(batches):
        known = shared.value
        ids, counts, chunks, held = [], [], [], 0

        def block():
            # the distinct words of all chunks: known ones by their place, others by their bytes
            place = np.concatenate([c[0] for c in chunks])
            raw, size = np.concatenate([c[1] for c in chunks]), np.concatenate([c[2] for c in chunks])
            end = np.cumsum(size)
            new_one, new_which = distinct_spans(raw, end - size, end)
            old, old_which = np.unique(place[place >= 0], return_inverse=True)
            code = np.empty(len(place), np.int64)
            code[place >= 0] = old_which
            code[place < 0] = len(old) + new_which
            flat, many = known.lists(old)
            offset, out = 0, []
            for c in chunks:
                out.append(code[offset : offset + len(c[0])][c[3]])
                offset += len(c[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(new_one)], pa.int32()), pairs.start(raw, (end - size)[new_one], size[new_one])),
                    pa.array([flat.tobytes()], pa.binary()),
                    pa.array([many.astype("<i4").tobytes()], pa.binary()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([np.concatenate(counts).astype("<i4").tobytes()], pa.binary()),
                    pa.array([np.concatenate(out).astype("<i4").tobytes()], pa.binary()),
                ],
                ["words", "known_ids", "known_sizes", "doc_ids", "counts", "codes"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for a, b in text_chunks(batch.column("text"), CHUNK_BYTES // 2):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                raw, first, last, which, n = _chunk_words(texts, joints.value)
                place = known.find(raw, first, last)
                new = place < 0
                size = (last - first)[new]
                chunks.append((place, raw[ranges(first[new], size)], size, which.astype(np.int32)))
                counts.append(n)
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += len(raw)
                if held >= block_bytes:
                    yield block()
                    ids, counts, chunks, held = [], [], [], 0
        if ids:
            yield block()

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                pieces = one.column("pieces").flatten()
                size = np.concatenate([np.frombuffer(one.column("known_sizes")[0].as_py(), "<i4"), pieces.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64)
                first = np.cumsum(size) - size
                flat = np.concatenate([np.frombuffer(one.column("known_ids")[0].as_py(), "<u4"), pieces.flatten().to_numpy().astype("<u4")])
                counts = np.frombuffer(one.column("counts")[0].as_py(), "<i4").astype(np.int64)
                codes = np.frombuffer(one.column("codes")[0].as_py(), "<i4")
                doc_ids = one.column("doc_ids").flatten()
                word_ends = np.cumsum(counts)
                a = 0
                while a < len(counts):  # some documents at a time
                    w0 = word_ends[a] - counts[a]
                    b = max(a + 1, int(np.searchsorted(word_ends, w0 + 200_000)))
                    use = codes[w0 : word_ends[b - 1]]
                    n = size[use]
                    tokens = flat[ranges(first[use], n)]
                    cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], word_ends[a:b] - w0])]
                    raw = tokens.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.slice(a, b - a),
                            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens.astype(np.int32))),
                            pa.array([raw[4 * x : 4 * y] for x, y in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        ],
                        ["doc_id", "ids", "ids_bytes"],
                    )
                    a = b

    # stored, so that a task of either half has one Python worker
    blocks = stored(src.mapInArrow(pack, f"words array<array<bigint>>, known_ids binary, known_sizes binary, doc_ids array<{kind}>, counts binary, codes binary"), "blocks", large_rows=True)
    folded = blocks.withColumn("_ranks", table).withColumn("pieces", F.transform("words", lambda w: merged_ids(w, pairs, F.col("_ranks")))).drop("words", "_ranks")
    return folded.mapInArrow(unpack, f"doc_id {kind}, ids array<int>, ids_bytes binary")


#: Pieces that are concatenated at once.
JOINED = 64


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of the text: the binary pieces of the ids, concatenated. Null ids give null, unknown ids nothing."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = constant(encoded.sparkSession, pieces=pieces)
    none = F.lit(b"")

    def groups(parts, piece):
        """One binary value for each ``JOINED`` parts."""
        last = F.greatest(F.floor((F.size(parts) - 1) / JOINED).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.aggregate(F.slice(parts, g * JOINED + 1, JOINED), none, lambda held, x: F.concat(held, piece(x))))

    table = "_pieces" + "_" * max(map(len, encoded.columns))  # no column's name
    small = groups(F.col(ids_col), lambda i: F.coalesce(F.get(F.col(table).pieces, i), none))
    joined = _let(_let(small, lambda s: groups(s, lambda x: x)), lambda large: F.aggregate(large, none, lambda held, x: F.concat(held, x)))
    return encoded.withColumn(table, vocabulary).withColumn(name, F.when(F.col(ids_col).isNotNull(), joined)).drop(table)
