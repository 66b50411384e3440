"""Periodic runs of words: stretches in which words q apart are the same, at least four times over.

A run has a smallest period q, at least max(6, 4q) words, and no neighbouring word that would extend it with this period. For each period p
in ascending order the grid 0, p, 2p, ... is probed: a run of at least 4p words holds four grid points, so three neighbouring pairs of them
(jp and (j+1)p) hold equal words. The harmonic sum of all grids is n log n probes. Grid points that lie in a run
found for a divisor of p are skipped, as they only tell of that run again. Survivors are probed at a few places between their grid points and then extended by comparing the words with
those p later in chunks of growing size, to both sides, after which all grid points of the stretch are done. A stretch that is
also a run of a divisor is no run of p.

Collapsing a text drops every word that some run holds after its first q words, so one copy of what repeats stays.

A text is handled where it lies, in memory of a few numbers a word and a bounded block of probes; nothing is shuffled. Null and empty texts have no words, no runs and
collapse to the empty text. Rows are handled one by one, whatever their ids; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_text
from .labelled import text_bytes

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of grid points probed at once.
PROBES = 1 << 18
#: Further places of a survivor that are looked at before it is extended.
PLACES = 8
FIRST_CHUNK, LARGEST_CHUNK = 64, 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def survivors(x: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods from ``first`` up to ``last`` and grid points a at which a run of at least four periods may hold a, a+p, a+2p and a+3p."""
    p = np.arange(first, last)
    n = np.maximum((len(x) - 1) // p - 2, 0)  # grid points a with a + 3p in the text
    period = np.repeat(p, n)
    a = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * period
    for _ in range(3):
        same = x[a] == x[a + period]
        a, period = a[same] + period[same], period[same]
    a -= 3 * period
    for k in range(1, PLACES):  # a run holds all words from a to a + 3p, so words p apart are equal from a to a + 2p
        i = a + 2 * period * k // PLACES
        same = x[i] == x[i + period]
        a, period = a[same], period[same]
    return a, period


def stretch(x: np.ndarray, a: int, p: int) -> tuple[int, int]:
    """The longest stretch of places i around a, from the first to behind the last, whose words are those at i + p."""
    n, low, high, size = len(x) - p, a, a, FIRST_CHUNK
    while high < n:
        end = min(n, high + size)
        off = np.flatnonzero(x[high:end] != x[high + p : end + p])
        if len(off):
            high += int(off[0])
            break
        high, size = end, min(2 * size, LARGEST_CHUNK)
    size = FIRST_CHUNK
    while low > 0:
        begin = max(0, low - size)
        off = np.flatnonzero(x[begin:low] != x[begin + p : low + p])
        if len(off):
            low = begin + int(off[-1]) + 1
            break
        low, size = begin, min(2 * size, LARGEST_CHUNK)
    return low, high


def all_stretches(x: np.ndarray, p: int) -> list[tuple[int, int]]:
    """What ``stretch`` finds around every place, in chunks over the whole text: for periods with many survivors."""
    out: list[tuple[int, int]] = []
    n, open_at = len(x) - p, -1
    for begin in range(0, n, LARGEST_CHUNK):
        end = min(n, begin + LARGEST_CHUNK)
        same = np.zeros(end - begin + 2, np.int8)
        same[1:-1] = x[begin:end] == x[begin + p : end + p]
        turns = np.diff(same)
        lows, highs = (np.flatnonzero(turns == t) + begin for t in (1, -1))
        if open_at >= 0 and same[1]:  # goes on from the chunk before
            lows[0], open_at = open_at, -1
        elif open_at >= 0:
            out.append((open_at, begin))
            open_at = -1
        if len(highs) and highs[-1] == end < n:
            open_at, lows, highs = int(lows[-1]), lows[:-1], highs[:-1]
        out += zip(lows.tolist(), highs.tolist())
    return out


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run of a text of numbered words: start, length, period, in order of start and period."""
    n = len(x)
    found: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of a period, ascending
    known: dict[tuple[int, int], int] = {}
    first = 1
    while first <= n // LEAST_PERIODS:
        last = first + 1
        last = max(last, min(n // LEAST_PERIODS + 1, first + PROBES * first // n))
        a, period = survivors(x, first, last)
        cuts = np.flatnonzero(np.diff(period, prepend=0, append=last + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            p, at = int(period[lo]), a[lo:hi]
            for q, (starts, ends) in found.items():
                if len(at) and p % q == 0:  # grid points that a run of a divisor holds, with the three that follow
                    i = np.searchsorted(starts, at, side="right") - 1
                    at = at[(i < 0) | (at + 3 * p >= np.array(ends)[i])]
            if len(at) > 64 and len(at) * 512 > n:
                held = np.zeros(0, np.int64)
                candidates = all_stretches(x, p)
            else:
                candidates, held = [], at
            while len(held):
                low, high = stretch(x, int(held[0]), p)
                candidates.append((low, high))
                held = held[np.searchsorted(held, high) :]
            for low, high in candidates:
                size = high - low + p
                if size >= max(LEAST_WORDS, LEAST_PERIODS * p) and (low, size) not in known:
                    known[low, size] = p
                    starts, ends = found.setdefault(p, ([], []))
                    starts.append(low)
                    ends.append(low + size)
        first = last
    return sorted((low, size, p) for (low, size), p in known.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int32)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period, in this order) and ``collapsed``, the kept words joined by spaces."""
    src = id_text(docs, id_col, text_col)

    def find(batch):
        words_of = [t.split() for t in text_bytes(batch)]
        all_runs = [runs(numbered(w)) for w in words_of]
        flat = np.array([r for found in all_runs for r in found], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, all_runs)])
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        texts = [b" ".join(w if not found else [w[i] for i in np.flatnonzero(kept(len(w), found)).tolist()]).decode() for w, found in zip(words_of, all_runs)]
        yield {"doc_id": batch.column("doc_id"), "n_words": list(map(len, words_of)), "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), "collapsed": texts}

    return arrow_rows(src, f"doc_id {dict(src.dtypes)['doc_id']}, n_words bigint, runs {RUNS}, collapsed string", find)


def longest(found: Column) -> Column:
    """The run of the greatest length, of these the one with the smallest start, then period; null without a run."""

    def better(a: Column, b: Column) -> Column:
        return (b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))

    return F.aggregate(found, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text alone) with a periodic tail written into a tenth of the texts, chosen and shaped by the CRC-32 h of the id in decimal: where h
    ends in 0, from word a on the text repeats its p words from there, with g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8) of n words. Such texts become
    their words joined by spaces. Rows without an id or words stay as they are."""
    src = id_text(docs, id_col, text_col)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = src.withColumns({"_h": h, "_g": g, "_words": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_words"))
    a = F.col("_g") % F.col("_n")
    p = 1 + F.floor((F.col("_n") - a) / (3 + F.col("_g") % 8))
    shaped = chosen.withColumn("_a", F.when(F.col("_n") > 0, a).cast("int")).withColumn("_p", F.when(F.col("_n") > 0, p).cast("int"))
    copies = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), copies))
    edited = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return shaped.select("doc_id", F.when(F.col("_n") > 0, edited).otherwise(F.col("text")).alias("text"))
