r"""Conversations as training text, with loss masks aligned by offsets.

A conversation becomes ``<turn>role<text>text</turn>`` and a line break for each turn, in order of turn. A text or role that holds one of the three control strings gets a
backslash behind its ``<``; one that holds such an escaped string gets one more. ``unescape`` takes one away, so nothing else in a text
changes and every text comes back.

The rendered conversation is encoded once, as a whole, by a byte-level tokenizer that also tells each token's offsets in
the text. The loss mask of its tokens comes from two binary searches for each span of an assistant's text among the sorted offsets: from the first token that ends behind the
span's start up to the first that starts at its end. The control strings are tokens of their own, added behind the vocabulary, so no token reaches over the edge of a span, and a
conversation cut between turns has the tokens of the whole one.

``format_conversations`` sorts the turns of a conversation in the task that has its key. Conversations of more than ``SPLIT_CHARS`` characters are range-sorted by turn instead and so
come from many tasks, as parts that follow each other, each rendered and encoded as a whole up to ``PART_CHARS`` characters; ``part`` numbers them, 0 for a conversation of one part.

Defined results: null texts and roles are empty; a null turn comes first, turns of one number come by role and text, repeated rows are
repeated turns; rows without a conversation id are one conversation of this id; other columns are not carried. No rows give no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
AFTER = "\n"
CONTROLS = (OPEN, TEXT, CLOSE)
_NAMES = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE, _UNESCAPE = re.compile(rf"<(\\*)({_NAMES})"), re.compile(rf"<\\(\\*)({_NAMES})")
_TURN = re.compile(f"{OPEN}(.*?){TEXT}(.*?){CLOSE}{AFTER}", re.DOTALL)
#: Roles whose texts are learnt.
LEARNT = ("assistant",)
#: Characters from which a conversation is spread over tasks by turn, and those of a part of it.
SPLIT_CHARS, PART_CHARS = 2_000_000, 500_000
#: Characters that are encoded at once.
BATCH_CHARS = 1 << 19


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1\2", text)


@dataclass
class Rendered:
    """A conversation, or a part of one, as text, with the spans of its texts to be learnt."""

    conv_id: object
    part: int
    turns: int = 0
    size: int = 0
    pieces: list[str] | None = None
    spans: list[tuple[int, int]] | None = None

    def add(self, role: str, text: str, learnt: tuple[str, ...]) -> None:
        head, body = f"{OPEN}{escape(role)}{TEXT}", escape(text)
        if self.pieces is None:
            self.pieces, self.spans = [], []
        if role in learnt and body:
            self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.pieces += [head, body, CLOSE + AFTER]
        self.size += len(head) + len(body) + len(CLOSE) + len(AFTER)
        self.turns += 1

    @property
    def text(self) -> str:
        return "".join(self.pieces or [])


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by ascending offsets, share a character with one of the ascending spans."""
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left")
    edge = np.zeros(len(starts) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


class Encoder:
    """The tokenizer of a file, with the control strings as tokens of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.tokenizer.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROLS])
        self.tokenizer.post_processor = None  # no trimmed offsets, no further tokens

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, starts and ends of the tokens of each text."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            out.append((np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1]))
        return out

    def decode(self, runs: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(runs, skip_special_tokens=False)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(id_type: str) -> str:
    return f"conv_id {id_type}, part bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def _encoded(rendered: list[Rendered], path: str, arrow_id: pa.DataType) -> pa.RecordBatch:
    texts = [r.text for r in rendered]
    tokens = encoder(path)(texts)
    masks = [loss_mask(s, e, r.spans or []) for r, (_, s, e) in zip(rendered, tokens)]
    at = pa.array(np.cumsum([0, *(len(t[0]) for t in tokens)]), pa.int32())

    def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(arrays).astype(bool if kind == pa.bool_() else np.int32), kind))

    columns = [
        pa.array([r.conv_id for r in rendered], arrow_id),
        pa.array([r.part for r in rendered], pa.int64()),
        pa.array(texts, pa.string()),
        *[lists([t[i] for t in tokens], pa.int32()) for i in range(3)],
        lists(masks, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"])


def _rendering(path: str, learnt: tuple[str, ...], part_chars: int | None):
    """For ``mapInArrow`` over turns (conv_id, turn, role, text) that come sorted: one row a conversation, or with ``part_chars`` one a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # parts follow each other: partitions do, as they are ranges, and so do the parts of one
        number = (TaskContext.get().partitionId() << 33) + 1 if part_chars else 0
        kind, ready, held, now = pa.int64(), [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if now is None or now.conv_id != conv_id or part_chars and now.size >= part_chars:
                    if now is not None:
                        ready.append(now)
                        held += now.size
                        if held >= BATCH_CHARS:
                            yield _encoded(ready, path, kind)
                            ready, held = [], 0
                    now = Rendered(conv_id, number)
                    number += bool(part_chars)
                now.add(role, text, learnt)
        if now is not None:
            yield _encoded([*ready, now], path, kind)

    return run


def format_conversations(
    rows: DataFrame,
    tokenizer_path: str,
    learnt: tuple[str, ...] = LEARNT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    split_chars: int = SPLIT_CHARS,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per conversation, or per part of a long one: ``conv_id, part, formatted``, and for each token its id, where it starts and ends in
    ``formatted`` (code points), and whether it is learnt."""
    empty = F.lit("")
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    schema = _schema(dict(turns.dtypes)["conv_id"])
    order = ["conv_id", "turn", "role", "text"]

    def whole(part: DataFrame) -> DataFrame:
        return part.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_rendering(tokenizer_path, learnt, None), schema)

    long = turns.groupBy("conv_id").agg(F.sum(F.length("text") + F.length("role")).alias("chars")).where(F.col("chars") > split_chars).select(F.col("conv_id").alias("_long"))
    if long.isEmpty():
        return whole(turns)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    # beginnings of texts are enough to deal out by, and small enough for the samples that ranges are made of
    edges = ["conv_id", "turn", *[F.substring(c, 1, 32) for c in ("role", "text")]]
    spread = turns.join(long, same, "left_semi").repartitionByRange(*edges).sortWithinPartitions(*order)
    return whole(turns.join(long, same, "left_anti")).union(spread.mapInArrow(_rendering(tokenizer_path, learnt, part_chars), schema))


def _turn_bytes(turns: list[tuple[str, str]]) -> bytes:
    return "".join(f"{role}\n{text}\n" for role, text in turns).encode()


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation. Raises an error where it is not made of whole turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("a formatted conversation holds something between its turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("a formatted conversation does not end with a turn")
    return turns


def learnt_texts(ids: np.ndarray, loss: np.ndarray, encode: Encoder) -> list[str]:
    """What the tokens under the mask say: each stretch of them decoded and unescaped."""
    edge = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    runs = [ids[a:b].tolist() for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return [unescape(t) for t in encode.decode(runs)]


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation, out of the output alone: ``n_turns``, ``turns_sha256`` (of role, line break, text, line break of each turn), ``loss_chars``
    and ``loss_sha256`` (of the texts that the ids under the mask decode to), ``formatted_chars``, and ``n_tokens``.

    A conversation of one part is digested where it lies. Only the bytes of parts of split ones move; a digest takes its bytes in order, so
    those of one conversation stream through one task, a part at a time.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["n_turns", "turns", "loss_chars", "loss", "formatted_chars", "n_tokens"]
    facts = "n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint, n_tokens bigint"
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def reading(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows, first, held = [], 0, 0
            for i in range(batch.num_rows):
                text = batch.column("formatted")[i].as_py()
                ids, loss = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "loss"))
                turns, texts = read_turns(text), learnt_texts(ids, loss, encode)
                data = [_turn_bytes(turns), "".join(texts).encode()]
                if batch.column("part")[i].as_py() == 0:  # nothing follows
                    data = [sha256(d).digest() for d in data]
                rows.append((len(turns), data[0], sum(map(len, texts)), data[1], len(text), len(ids)))
                held += sum(map(len, data))
                if held > BATCH_CHARS or i == batch.num_rows - 1:
                    keys = [batch.column(c).slice(first, len(rows)) for c in ("conv_id", "part")]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v, t) for v, t in zip(zip(*rows), types)]], ["conv_id", "part", *names])
                    rows, first, held = [], i + 1, 0

    def joining(batches):
        conv, state = None, None

        def closed():
            values = [v.digest() if hasattr(v, "digest") else v for v in state]
            return pa.RecordBatch.from_arrays([conv, *[pa.array([v], t) for v, t in zip(values, types)]], ["conv_id", *names])

        for batch in batches:
            keys = batch.column("conv_id")
            whole = np.flatnonzero(batch.column("part").to_numpy() == 0)
            if len(whole):
                yield batch.take(pa.array(whole)).select(["conv_id", *names])
            for i in np.flatnonzero(batch.column("part").to_numpy() != 0).tolist():
                if conv is None or keys[i].as_py() != conv[0].as_py():
                    if conv is not None:
                        yield closed()
                    conv, state = keys.slice(i, 1), [0, sha256(), 0, sha256(), 0, 0]
                for k, name in enumerate(names):
                    value = batch.column(name)[i].as_py()
                    if hasattr(state[k], "update"):
                        state[k].update(value)
                    else:
                        state[k] += value
        if conv is not None:
            yield closed()

    read = formatted.select("conv_id", "part", "formatted", "ids", "loss").mapInArrow(reading, f"conv_id {kind}, part bigint, {facts}")
    joined = read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(joining, f"conv_id {kind}, {facts}")
    return joined.select("conv_id", "n_turns", F.lower(F.hex("turns")).alias("turns_sha256"), "loss_chars", F.lower(F.hex("loss")).alias("loss_sha256"), "formatted_chars", "n_tokens")


#: A conversation whose texts hold signs of templates.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the probe conversation of two turns."""
    spark: SparkSession = rows.sparkSession
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").union(probe)
