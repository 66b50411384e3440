"""Shared helpers of the text operators: safe inputs, shared work folders, Arrow loops.

Every operator takes a DataFrame with an id and a text column under any names and
with any further columns. A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored, work_dir  # noqa: F401  (the operators take them from here)

#: Bytes of text that a Python helper handles at once (one longer text is handled whole).
CHUNK_BYTES = 1 << 20


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash or be carried."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def arrow_rows(df: DataFrame, schema: str, chunk: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` with a helper that turns a small batch of rows into columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields if isinstance(fields, StructType) else StructType([fields]))

    def run(batches):
        for batch in batches:
            for a, b in text_chunks(batch.column("text")):
                for columns in chunk(batch.slice(a, b - a)):
                    yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class Codes:
    """Code points of several texts in one array, with the class of each: letter, number, space or other."""

    LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
    #: Code points with the Unicode property White_Space (fixed values).
    SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            import sys
            import unicodedata

            kinds = {"L": cls.LETTER, "N": cls.NUMBER}
            t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], cls.OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
            t[cls.SPACES] = cls.SPACE
            cls._table = t
        return cls._table

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = self.table()[self.points]
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))

    def runs(self) -> np.ndarray:
        """Starts of the longest stretches of one class within one text."""
        n = len(self.kind)
        new = np.ones(n, bool)
        new[1:] = self.kind[1:] != self.kind[:-1]
        new[self.ends[self.ends < n]] = True
        return np.flatnonzero(new)


#: Odd multiplier of the running polynomial modulo 2^64, which has an inverse.
PRIME = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (PRIME, pow(PRIME, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK_BYTES + 64), base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of values, from one running polynomial: to group by, never to tell stretches apart."""
    up, down = _prime_powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def differing(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches of ``a`` and ``b``, pair by pair of one size, are not the same."""
    off = np.flatnonzero(a[ranges(a_first, size)] != b[ranges(b_first, size)])
    out = np.zeros(len(size), bool)
    out[np.searchsorted(np.cumsum(size), off, side="right")] = True
    return out


def stretches(size: np.ndarray, limit: int = CHUNK_BYTES // 4) -> Iterator[slice]:
    """Stretches of spans with about ``limit`` values in all, so that work on them stays small."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + limit, side="right")))
        yield slice(a, b)
        a = b


def distinct_spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One stretch of each distinct content, and which of these every stretch has; stretches come in order of their place. Stretches
    of one hash are compared value by value, so equal hashes of different stretches do no harm."""
    size = last - first
    h = np.empty(len(first), np.uint64)
    for s in stretches(size):
        at = first[s.start]
        h[s] = span_hashes(values[at : last[s.stop - 1]], first[s] - at, last[s] - at)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    rest = order[~new]
    bad = size[rest] != size[one[which[rest]]]
    same = np.flatnonzero(~bad)
    for s in stretches(size[rest[same]]):
        x = rest[same[s]]
        bad[same[s]] = differing(values, first[x], values, first[one[which[x]]], size[x])
    found: dict[tuple[int, bytes], int] = {}
    more = []
    for i in rest[bad].tolist():  # another content with the hash of the first
        key = (int(h[i]), values[first[i] : last[i]].tobytes())
        if key not in found:
            found[key] = len(one) + len(more)
            more.append(i)
        which[i] = found[key]
    return np.append(one, np.array(more, np.int64)), which


#: Contractions that the split patterns take as one piece (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def contractions(codes: Codes, starts: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Among the runs at ``starts``, those that are one apostrophe where a piece begins (``free``) and whose
    following letters begin with a contraction: their indices, and how many letters belong to it."""
    points, n = codes.points, len(codes.points)
    stops = np.append(starts[1:], n)
    at = np.flatnonzero(free & (points[starts] == 39) & (stops - starts == 1) & (stops < n))
    at = at[~np.isin(stops[at], codes.ends) & (codes.kind[stops[at]] == Codes.LETTER)] if len(at) else at
    taken = np.zeros(len(at), np.int64)
    for k, i in enumerate(at):
        a, b = stops[i], stops[i + 1]
        letters = codes.text[a : min(b, a + 2)]
        taken[k] = next((len(c) for c in CONTRACTIONS if letters.startswith(c)), 0)
    return at[taken > 0], taken[taken > 0]


def kept_rows(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts, with all their columns, without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(place), "")
            for a, b in text_chunks(texts):
                mask = np.asarray(keep(texts.slice(a, b - a).cast(pa.binary()).to_pylist()), bool)
                yield batch.slice(a, b - a).filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)
