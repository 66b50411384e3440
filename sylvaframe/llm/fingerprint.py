"""Threshold-scaled sketches of documents, in DataFrame functions only.

The fingerprint of a text is the sorted set of those XXH64 hashes of its five-word shingles that lie in the
lowest ``1 / SCALE`` of all 64-bit values. As the same threshold holds for every text, sketches of parts merge into
the sketch of the whole, and intersections estimate resemblance and containment even of very unequal texts.
A text with no hash under the threshold keeps its least one, so that no fingerprint is empty; a merged sketch keeps
it only where it has no hash under the threshold either, as the sketch of the whole would.

Words are the stretches between white space of the lower-cased text; a text of fewer than five words is one
shingle, an empty or null text the shingle of no words. Equal texts have equal fingerprints; repeated
shingles count once. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, stored

SHINGLE = 5
SCALE = 8
#: Documents of a block of neighbours, and the most bounds that are taken from quantiles.
BLOCK_ROWS = 4096
BOUNDS = 1000


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _top(scale: int) -> int:
    """The largest hash that is retained."""
    return -(1 << 63) + (1 << 64) // scale - 1


def _kept(hashes: Column, scale: int) -> Column:
    """The sorted distinct hashes up to the threshold, or the least one."""
    return _let(F.filter(hashes, lambda x: x <= F.lit(_top(scale))), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes))))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted retained hashes (array<bigint>) of a text."""
    words = F.transform(F.split(F.btrim(F.lower(text), F.lit(" \t\n\r\f\x0b")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: F.xxhash64(w))

    def retained(w):
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        # an index behind the last word gives null, which leaves the hash of the words before as it is
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return _let(hashes, lambda h: _kept(h, scale))

    return _let(words, retained)


def as_text(hashes: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together, of their sketches."""
    return _let(F.array_union(a, b), lambda h: _kept(h, scale))


def resemblance(a: Column, b: Column) -> Column:
    """Share of the hashes of either sketch that are in both."""
    return _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def containment(a: Column, b: Column) -> Column:
    """Share of the hashes of ``a`` that ``b`` has."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``doc_id`` and ``sketch`` of every row, without a shuffle."""
    return id_text(docs, id_col, text_col).select("doc_id", sketch(F.col("text"), shingle, scale).alias("sketch"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, _extra) in blocks of neighbouring ids, each block closed by an extra row, the first
    of the next block (of the first block after the last), and the window that orders a block.

    Block bounds are quantiles of the ids, cut further into equal widths where there are many blocks; ids that are no
    numbers, of any type that has an order, have at most ``BOUNDS`` blocks. Rows
    without an id come first; equal ids follow each other in an order fixed by their texts.
    """
    src = id_text(docs, id_col, text_col)
    n = src.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    m = min(blocks, BOUNDS)
    kind = src.schema["doc_id"].dataType
    number = isinstance(kind, T.NumericType)
    if number:
        bounds = src.agg(F.percentile_approx("doc_id", [k / m for k in range(m + 1)], 20 * m).alias("b")).head().b or []
    else:  # the least id of each of the ranges that Spark makes of a sample; at most BOUNDS of them
        ranges = src.select("doc_id").where("doc_id is not null").repartitionByRange(m, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("b"))
        bounds = [r.b for r in ranges.collect()]
    bounds = sorted(set(bounds))
    each = -(-blocks // m) if number else 1
    none = F.array().cast(T.ArrayType(kind))
    lows = bounds[:-1] if number else bounds
    known = F.array(*map(F.lit, lows)).cast(T.ArrayType(kind)) if lows else none
    above = F.array(*map(F.lit, bounds[1:])).cast(T.ArrayType(kind)) if len(bounds) > 1 else none
    place = F.size(F.filter(known, lambda b: b <= F.col("doc_id")))

    def block(p):
        if not number:
            return F.coalesce(p, F.lit(0)).cast("bigint")
        low, high = F.get(known, p - 1), F.get(above, p - 1)
        part = F.floor((F.col("doc_id") - low) * F.lit(each) / (high - low))
        return p.cast("bigint") * each + F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(each - 1)), F.lit(0))

    rows = src.withColumn("_block", _let(place, block))
    heads = stored(rows.groupBy("_block").agg(F.min("doc_id").alias("_head")).where("_head is not null"), "heads")
    order = Window.orderBy("_block")  # one row for each block of documents
    heads = heads.select("_head", F.lag("_block").over(order).alias("_before"), F.max("_block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    extra = rows.join(heads, rows["doc_id"] == heads["_head"]).select("doc_id", "text", F.coalesce("_before", "_last").alias("_block"), F.lit(True).alias("_extra"))
    every = rows.select("doc_id", "text", "_block", F.lit(False).alias("_extra")).union(extra)
    return every, Window.partitionBy("_block").orderBy("_extra", "doc_id", F.xxhash64("text"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Of every row ``doc_id``, ``text``, ``edited`` (its second half replaced by the beginning of the next
    document), and the sketches ``own``, ``edited_sketch`` and ``next_sketch``."""
    rows, order = with_next(docs, id_col, text_col)
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("own", sketch(F.col("text"), shingle, scale))
    rows = rows.withColumn("next_sketch", F.lead("own").over(order)).where(~F.col("_extra"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    return rows.select("doc_id", "text", edited.alias("edited"), "own", "next_sketch").withColumn("edited_sketch", sketch(F.col("edited"), shingle, scale))
