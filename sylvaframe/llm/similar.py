"""Near-duplicates by the similarity of word shingles, found with SimHash fingerprints and keys of the Golay code.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8. A text's fingerprint has
five segments of 23 bits, each bit the majority over its distinct shingles. The Golay code of length 23 is perfect, so a segment's nearest
codeword is at most 3 bits away; a segment gets all codewords at distance 4 or less (5.3 on average), and two segments that
differ in a few bits mostly share one. At a similarity of 0.8 about 17 of the 115 bits differ. By the pigeonhole principle
they can't be many in all segments, so texts that agree in a codeword near two of the five segments are candidates: for each
pair of segments a key for each pair of their codewords. Candidates with at most ``DISTANCE`` differing bits are verified on their whole
shingle sets. What is linked is exact; which links are found is not: a pair at similarity 0.8 meets with
probability 0.95, at 0.9 with 0.99, and groups of copies meet more often, as one link of many is enough.

Texts with the same shingles are one node. At first each fingerprint meets one other only: the first in its largest key, or the one that is close there.
Once these links are joined to components, the members outside the largest component of a key meet that component's first member in the key. All
members of keys that still hold several components then meet at once, whatever their keys and the size of these, where a prefix filter over their shingle
sets leaves a pair of different components. It orders shingles from rare to frequent; two sets of this similarity share one among the first fifth of each, the
places of the first that they share bound how many they can share in all, and the parity of the shingles in each of ``PARITY`` classes bounds in how many they differ.
All three are exact, so no link between components is left out, and of a crowd of near copies only pairs about as similar as links are become rows.

Words are those of ``simhash``; a text of fewer words is one shingle, an empty or null text has none and is a copy of the others. Rows are
taken one by one: equal ids are rows of their own, rows without an id are linked but never named. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, id_text, stored
from .components import connected_components
from .simhash import first_rows, near_codewords

SHINGLE = 5
SIMILARITY = 0.8
DISTANCE = 31
#: Members of a key up to which a text stays in all of its keys; of larger keys it stays in one.
FEW = 64
#: Rows of a key that are compared with each other at once; larger keys are kept whole.
CROWD = 256
SEGMENTS, WIDTH = 5, 23
_WORD = np.uint64((1 << WIDTH) - 1)
#: Bits of the parity sketch of a shingle set.
PARITY = 512


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The XXH3 digests (128 bits, as two numbers) of the distinct word shingles, sorted."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros((0, 2), np.uint64)
    plain = b" ".join(words)
    if n <= size:
        parts = {plain}
    else:
        long = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(long + 1) - long - 1
        parts = {plain[a:b] for a, b in zip(start[: n - size + 1].tolist(), (start + long)[size - 1 :].tolist())}
    found = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """The lower 64 and the upper 51 bits of the majority of each bit."""
    if not len(found):
        return 0, 0
    ones = np.unpackbits(found.view(np.uint8).reshape(len(found), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    low, high = np.packbits(2 * ones > len(found), bitorder="little").view("<u8").tolist()
    return low - (1 << 64) if low >> 63 else low, high & (1 << 51) - 1


def _described(batch, size: int):
    import xxhash

    low, high, content = [], [], []
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        found = shingles(text, size)
        a, b = fingerprint(found)
        low.append(a)
        high.append(b)
        content.append(xxhash.xxh3_128_digest(found.tobytes()))
    yield {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "low": low, "high": high, "content": content}


def band_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each pair of segments every pair of codewords near them."""
    low, high = low.view(np.uint64), high.astype(np.uint64)
    wide = [low & _WORD, low >> np.uint64(23) & _WORD, (low >> np.uint64(46) | high << np.uint64(18)) & _WORD, high >> np.uint64(5) & _WORD, high >> np.uint64(28)]
    near = [near_codewords(w.astype(np.int64)) for w in wide]  # (codewords, first, size)
    rows, keys, kind = [], [], 0
    for a in range(SEGMENTS):
        for b in range(a + 1, SEGMENTS):
            (ca, fa, na), (cb, fb, nb) = near[a], near[b]
            n = na * nb
            row = np.repeat(np.arange(len(low)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append(row)
            keys.append(kind << 24 | ca[fa[row] + k // nb[row]] << 12 | cb[fb[row] + k % nb[row]])
            kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 4000):
            part = batch.slice(a, 4000)
            low, high = part.column(0).to_numpy(), part.column(1).to_numpy()
            row, key = band_keys(low, high)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low[row]), pa.array(high[row])], ["key", "low", "high"])


_PAIR = ["low", "high", "low2", "high2"]
_MET = [*_PAIR, "size", "crowd"]


def _differ(low, high, low2, high2):
    return np.bitwise_count((low ^ low2).view(np.uint64)).astype(np.int64) + np.bitwise_count((high ^ high2).view(np.uint64))


def _meet(distance: int, crowd: int):
    """Of rows sorted by key: every member of a key in which some are close, with one that is close to it (or itself), the number of
    members, and a number for the set of members, so that keys with the same members count once."""

    def runs(key, low, high):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        hub, each = np.repeat(cut, size), np.repeat(size, size)
        row = np.arange(len(key))
        partner = np.where(_differ(low, high, low[hub], high[hub]) <= distance, hub, row)
        close = partner != row
        small = each <= crowd
        for d in range(1, min(crowd, int(size.max(initial=1)))):
            at = np.flatnonzero(small[d:] & (hub[d:] == hub[:-d])) + d
            if not len(at):
                break
            near = at[_differ(low[at], high[at], low[at - d], high[at - d]) <= distance]
            close[near] = close[near - d] = True
            alone = near[partner[near] == near]
            partner[alone] = alone - d
        mixed = (low * 0x9E3779B97F4A7C1) ^ (high * 0x2545F4914F6CDD1)
        members = np.add.reduceat(mixed * mixed + mixed, cut) if len(key) else mixed
        name = np.where(size > crowd, key[cut], members)
        use = close | ~small
        p = partner[use]
        return low[use], high[use], low[p], high[p], each[use], np.repeat(name, size)[use]

    def run(batches):
        held = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            key = rows[0]
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - end > 4 * crowd:  # a large key goes on as its first member and as many as make it large
                done, keep = len(key), slice(end, end + crowd + 1)
            else:
                done, keep = end, slice(end, len(key))
            held = [c[keep] for c in rows]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in runs(*[c[:done] for c in rows])], _MET)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in runs(*held)], _MET)

    return run


def parity(hashes: np.ndarray) -> list[int]:
    """A bit for each remainder of the hashes: whether it comes up an odd number of times. The sketches of two sets differ in no more bits than the sets in members."""
    odd = (np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def _sets(contents: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``content``, ``set``, its shingles, and ``sketch``, their parity, of each content. ``docs`` has doc_id, mark and text."""
    wanted = contents.join(nodes, "content").select("content", "rep.doc_id", "rep.mark")
    texts = wanted.join(docs, wanted["doc_id"].eqNullSafe(docs["doc_id"]) & (wanted["mark"] == docs["mark"])).select("content", "text")

    def run(batch):
        sets = [shingles(t, size)[:, 0] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield {"content": batch.column("content"), "set": [x.view(np.int64) for x in sets], "sketch": [parity(x) for x in sets]}

    return stored(arrow_rows(texts, "content binary, set array<bigint>, sketch array<bigint>", run).dropDuplicates(["content"]), "shingle-sets")


def _overlapping(members: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of different roots, one of them ``outside``, that can be similar enough by a prefix filter: no pair that is so is left out.

    ``members`` has content, root and outside.
    """
    sets = _sets(members.select("content"), nodes, docs, size)
    rows = sets.join(members, "content").select("content", "root", "outside", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), (F.min("root") != F.max("root")).alias("mixed")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("content").orderBy(F.coalesce("df", F.lit(1)), "s"))
    first = rows.join(often, "s", "left").withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1) & F.col("mixed"))
    first = first.select("content", "root", "outside", "n", "s", "place").join(sets.select("content", "sketch"), "content")
    first = stored(first, "prefixes")
    one = first.where("outside").select("s", *[F.col(c).alias(f"{c}1") for c in ("content", "root", "n", "place", "sketch")])
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1"))  # from the first that they share on
    enough = most >= similarity / (1 + similarity) * (F.col("n") + F.col("n1")) - 1e-6
    alike = F.least("n", "n1") >= similarity * F.greatest("n", "n1") - 1e-6
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch1")[i])) for i in range(PARITY // 64)), F.lit(0))
    close = differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("n1")) + 1e-6
    both = one.join(first, (one["s"] == first["s"]) & (F.col("root") != F.col("root1")) & alike & enough & close)
    return both.select(F.least("content", "content1").alias("a"), F.greatest("content", "content1").alias("b")).distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of contents whose shingle sets are similar enough. ``docs`` has doc_id, mark and text."""
    sets = _sets(pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct(), nodes, docs, size)
    a, b = sets.select(F.col("content").alias("a"), F.col("set").alias("x")), sets.select(F.col("content").alias("b"), F.col("set").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    return stored(both.where(F.col("n") >= similarity * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b"), "similar")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int = DISTANCE, crowd: int = CROWD, few: int = FEW) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``class`` and ``component_id``, the least id of the class, of every row."""
    src = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    kind = dict(src.dtypes)["doc_id"]
    own = stored(arrow_rows(src, f"doc_id {kind}, mark bigint, low bigint, high bigint, content binary", lambda batch: _described(batch, shingle)), "described")
    nodes = stored(own.groupBy("content").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.min(F.struct("doc_id", "mark")).alias("rep")), "contents")
    prints = nodes.groupBy("low", "high").agg(F.min("content").alias("hub"), F.count(F.lit(1)).alias("n"))
    prints = stored(prints, "prints")
    keyed = prints.select("low", "high").mapInArrow(_keyed, "key bigint, low bigint, high bigint")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    sorted_ = keyed.repartition(parts, "key").sortWithinPartitions("key", "low", "high")
    rows = sorted_.mapInArrow(_meet(distance, crowd), ", ".join(f"{c} bigint" for c in _MET))
    met = stored(rows.groupBy("crowd", "low", "high").agg(F.max(F.struct("size", "low2", "high2")).alias("best")), "met")

    # each fingerprint meets its partner in the largest key; further contents of a fingerprint meet its first
    hub = prints.select("low", "high", "hub")
    best = met.groupBy("low", "high").agg(F.max("best").alias("best")).select("low", "high", F.col("best.low2").alias("low2"), F.col("best.high2").alias("high2")).where("low <> low2 or high <> high2")
    pairs = best.join(hub.withColumnRenamed("hub", "a"), ["low", "high"]).select("a", F.col("low2").alias("low"), F.col("high2").alias("high"))
    pairs = pairs.join(hub.withColumnRenamed("hub", "b"), ["low", "high"]).select("a", "b")
    shared = nodes.join(prints.where("n > 1"), ["low", "high"]).select("low", "high", "hub", "content")
    pairs = pairs.union(shared.where("content <> hub").select("hub", "content")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(pairs.distinct(), "candidates")
    found = _similar(tried, nodes, src, shingle, similarity)
    roots = connected_components(found)
    members = met.select("crowd", "low", "high", F.col("best.size").alias("of")).union(prints.where("n > 1").select(F.xxhash64("low", "high"), "low", "high", "n"))
    # of large keys one is enough: what is in any of them meets by shingles at last, so small keys all of whose members are in large ones have nothing to add
    members = members.withColumn("top", F.max("of").over(Window.partitionBy("low", "high")))
    large = members.where(F.col("of") > few).groupBy("low", "high").agg(F.max(F.struct("of", "crowd")).alias("top")).select("top.crowd", "low", "high", "top.of")
    small = members.where(F.col("of") <= few).withColumn("least", F.min("top").over(Window.partitionBy("crowd"))).where(F.col("least") <= few).select("crowd", "low", "high", "of")
    crowds = stored(small.union(large).join(nodes.select("low", "high", "content"), ["low", "high"]).select("crowd", "content", "low", "high", "of"), "crowds")
    near = F.bit_count(F.col("low").bitwiseXOR(F.col("low1"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high1"))) <= distance
    both_ends = [F.least("content", "content1").alias("a"), F.greatest("content", "content1").alias("b")]
    for whole in (False, True):
        member = crowds.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
        if whole:
            # all that are in a large key, or in a small one with members of several components, meet by shingles
            mixed = member.groupBy("crowd").agg((F.min("root") != F.max("root")).alias("mixed"))
            crowded = stored(member.join(mixed, "crowd").where((F.col("of") > few) | F.col("mixed")).select("content", "root").distinct(), "crowded")
            largest = crowded.groupBy("root").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "root").head()
            if largest is None:
                break
            more = _overlapping(crowded.withColumn("outside", F.col("root") != F.lit(largest.root)), nodes, src, shingle, similarity)
        else:
            counted = member.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("content", "low", "high")).alias("first"))
            main = counted.groupBy("crowd").agg(F.max(F.struct("m", "root", "first")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
            outside = member.join(main, "crowd").where("root <> main.root").select(*[F.col(c).alias(f"{c}1") for c in ("content", "low", "high")], "main.first")
            more = outside.select("content1", "low1", "high1", "first.*").where(near).select(*both_ends)
        more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"), "crowd-candidates")
        if not more.isEmpty():
            found = found.union(_similar(more, nodes, src, shingle, similarity))
            tried = tried.union(more)
            roots = connected_components(found)
    classes = stored(nodes.join(roots.withColumnRenamed("node", "content"), "content", "left").select("content", F.coalesce("root", "content").alias("class"), F.col("rep.doc_id").alias("least")), "classes")
    names = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return own.join(classes.join(names, "class").select("content", "class", "component_id"), "content").select("doc_id", "mark", "class", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that come first in their class (see ``simhash.first_rows``)."""
    return first_rows(docs, similar_texts(docs, id_col, text_col, **options), id_col, text_col)
