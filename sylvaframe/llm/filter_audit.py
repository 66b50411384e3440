"""What each filter of a chain removes, in every order, from one pass over the documents.

``judged`` finds what each text fails, a batch at a time. Every document fails some of k filters; its failures are a mask of k bits. ``mask_counts`` counts the documents of each part and mask, in
all and by label. ``survivors`` turns these 2^k counts by a subset-zeta transform (k rounds, each adding to every mask with a bit the count
without it) into the number of documents that survive each subset of filters: those whose mask lies in the complement. ``steps`` then reads
every step of every order off as the difference between two neighbouring subsets, so orders cost no further look at the documents.

Defined results: null and empty texts have no words and fail only A. A null part is the part ''. Rows that repeat an
id are counted one by one, and none of them repeats another of the same id. A null id is smaller than none and nothing is smaller than it.
A document with several labels is good (toxic) if any of its labels says so; without a label it is neither. No rows give no rows. Other
columns are not carried and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import blake2b, sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stored
from .labelled import text_bytes

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Filters at most: 2^k counts a part are held in one row.
MOST_FILTERS = 12
#: Failure conditions of a text (bytes of UTF-8), its words (as ``bytes.split`` finds them: between spaces and the controls 9 to 13)
#: and its number of code points: few words, repeated words, capitals, signs.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes], int], bool]] = {
    "A": lambda text, words, points: len(words) < 50,
    "B": lambda text, words, points: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, words, points: 100 * (len(text) - len(text.translate(None, LETTERS))) > 5 * points,
    "D": lambda text, words, points: len(text) > len(text.translate(None, SIGNS)),
}


def judged(docs: DataFrame, filters: dict[str, Callable[[bytes, list[bytes], int], bool]] = TEXT_FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id``, ``part``, the failures of each text by name, and what stands for the text itself: its ``digest`` (SHA-256 and BLAKE2b) and ``bytes``."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))

    def judge(batch):
        texts = text_bytes(batch)
        points = pa.compute.utf8_length(batch.column("text")).to_pylist()
        failed = [[bool(f(t, w, n)) for f in filters.values()] for t, w, n in ((t, t.split(), n) for t, n in zip(texts, points))]
        digests = [sha256(t).digest() + blake2b(t, digest_size=16).digest() for t in texts]
        yield {"id": batch.column("id"), "part": batch.column("part"), "digest": digests, "bytes": list(map(len, texts))} | {f: [x[i] for x in failed] for i, f in enumerate(filters)}

    return arrow_rows(src, f"id {dict(src.dtypes)['id']}, part string, digest binary, bytes bigint, " + ", ".join(f"{f} boolean" for f in filters), judge)


def with_repeats(rows: DataFrame, filters: list[str], name: str = "E") -> DataFrame:
    """``part``, ``id``, ``n`` rows, ``filters`` and ``name``: whether some smaller id has the same text anywhere in the table.

    Rows of one text, id and part are counted together and written once. The smallest id of a text is a partial sum over
    these and meets them again by text and id, so copies of one text never meet in one task.
    """
    alike = ["digest", "bytes"]
    counted = stored(rows.groupBy(*alike, "id", "part", *filters).agg(F.count(F.lit(1)).alias("n")), "judged")
    first = counted.where("id is not null").groupBy(*alike).agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = counted.join(first, [*alike, "id"], "left")
    return marked.select("part", "id", "n", *filters, (F.col("first").isNull() & F.col("id").isNotNull()).alias(name))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` (a label of quality 1) and ``toxic`` (a label of toxic 1) by ``id``."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(told, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(rows: DataFrame, filters: list[str], labels: list[str], part_col: str = "part", n_col: str = "n") -> DataFrame:
    """One row per part: ``all`` and a column per label, each an array of the number of documents by mask. ``filters`` and ``labels``
    are boolean columns; bit i of a mask is the i-th filter. One sum per part, mask and label, made where the rows lie first."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")
    bit = [F.when(F.col(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)]
    sums = [F.sum(n_col).alias("all"), *[F.sum(F.when(F.col(x), F.col(n_col)).otherwise(0)).alias(x) for x in labels]]
    by_mask = rows.groupBy(part_col, reduce(lambda a, b: a + b, bit).alias("mask")).agg(*sums)
    held = by_mask.groupBy(part_col).agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", *labels)))).alias("by_mask"))  # 2^k entries at most
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    zero = F.lit(0).cast("bigint")

    def by_place(x: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.col("by_mask")[m][x], zero)).alias(x)

    return held.select(part_col, *map(by_place, ("all", *labels)))


def zeta(counts: Column, k: int) -> Column:
    """The sum of an array of 2^k counts over all subsets of each mask, bit by bit."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def add(held: Column, bit: Column) -> Column:
        return F.transform(every, lambda m: held[m] + F.when(m.bitwiseAND(bit) != 0, held[m.bitwiseXOR(bit)]).otherwise(0))

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(k)]), counts, add)


def survivors(counts: DataFrame, k: int, part_col: str = "part") -> DataFrame:
    """``counts`` with each array put in place by subset of filters: how many documents none of them removes."""
    names = [c for c in counts.columns if c != part_col]
    summed = counts.select(part_col, *[zeta(F.col(c), k).alias(c) for c in names])
    # the subset s of filters lets through the masks within its complement, which is 2^k - 1 - s
    return summed.select(part_col, *[F.reverse(c).alias(c) for c in names])


def steps(counts: DataFrame, filters: list[str], lost: dict[str, str], orders: list[tuple[str, ...]] | None = None, part_col: str = "part") -> DataFrame:
    """One row per part, order of filters (all by default) and step: ``part, filter_order, step, kept, removed, redundant, unique_fails``, a column for each
    label of ``lost`` (by its name in the result) and ``shapley``, the filter's removals summed over all orders of all filters.

    Of f after the filters P: removed is survivors(P) - survivors(P + f), and likewise for the labels; shapley sums this over every P without
    f, as often as orders begin with P and f.
    """
    k = len(filters)
    orders = list(permutations(filters)) if orders is None else orders
    left = survivors(counts, k, part_col)

    def shapley(i: int) -> Column:
        parts = [p.bit_count() - (p >> i & 1) for p in range(1 << k)]
        weights = [(-1 if p >> i & 1 else 1) * factorial(n) * factorial(k - 1 - n) for p, n in enumerate(parts)]
        return F.aggregate(F.zip_with("all", F.lit(weights), lambda n, w: n * w), F.lit(0).cast("bigint"), lambda x, y: x + y)

    every = (1 << k) - 1
    alone = F.transform(F.lit([every ^ (1 << i) for i in range(k)]), lambda m: F.col("all")[m] - F.col("all")[every])
    fails = F.transform(F.lit([1 << i for i in range(k)]), lambda m: F.col("all")[0] - F.col("all")[m])
    whole = left.withColumns({"_shapley": F.array(*map(shapley, range(k))), "_alone": alone, "_fails": fails})
    # an order is the places of its filters, a character each
    sign = {f: chr(ord("a") + i) for i, f in enumerate(filters)}
    written = whole.withColumn("_order", F.explode(F.lit(["".join(sign[f] for f in o) for o in orders])))
    each = written.select("*", F.posexplode(F.split("_order", "")).alias("_pos", "_sign"))

    def place(c: Column) -> Column:
        return F.ascii(c) - ord("a")

    def mask(signs: Column) -> Column:
        return F.aggregate(F.split(signs, ""), F.lit(0), lambda m, c: m + F.when(c == "", 0).otherwise(F.element_at(F.lit([1 << i for i in range(k)]), place(c) + 1)))

    rows = each.withColumns({"_at": place(F.col("_sign")), "_before": mask(F.substring("_order", F.lit(1), F.col("_pos"))), "_after": mask(F.substring("_order", F.lit(1), F.col("_pos") + 1))})

    def gone(c: str) -> Column:
        return F.col(c)[F.col("_before")] - F.col(c)[F.col("_after")]

    return rows.select(
        part_col,
        F.array_join(F.transform(F.split("_order", ""), lambda c: F.element_at(F.lit(filters), place(c) + 1)), "").alias("filter_order"),
        (F.col("_pos") + 1).alias("step"),
        F.col("all")[F.col("_after")].alias("kept"),
        gone("all").alias("removed"),
        (F.col("_fails")[F.col("_at")] - gone("all")).alias("redundant"),
        F.col("_alone")[F.col("_at")].alias("unique_fails"),
        *[gone(c).alias(name) for name, c in lost.items()],
        F.col("_shapley")[F.col("_at")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters ``A`` to ``E``, per source of the documents."""
    failed = with_repeats(judged(docs), [*TEXT_FILTERS])
    filters = [*TEXT_FILTERS, "E"]
    counts = mask_counts(with_labels(failed, labels), filters, ["good", "toxic"])
    return steps(counts, filters, {"good_lost": "good", "toxic_lost": "toxic"})
