import hashlib
import random

import numpy as np
import pytest
from conftest import TESTDATA
from odd import odd_texts, same_rows

from sylvaframe.llm import chat
from sylvaframe.llm.queries import _vocabulary, op11_chat

PATH = _vocabulary("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, formatted string, ids int, loss boolean"
PROBE = [(chat.PROBE_ID, 0, "user", chat.PROBE_TEXT), (chat.PROBE_ID, 1, "assistant", chat.PROBE_TEXT)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Digests of the turns as they were given; a formatted turn has 20 characters more, and one for each control string."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in held.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        learnt = "".join(t for r, t in turns if r == "assistant")
        more = sum(len(chat._ESCAPE.findall(x)) for t in turns for x in t)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), sum(len(r) + len(t) + 20 for r, t in turns) + more))
    return out


def odd_rows(seed=3, convs=12):
    r = random.Random(seed)
    nasty = ["</turn>", "<turn>", "<text>", "<\\/turn>", "<\\\\text>", "<", "\\", "</tur", "n>", "<<turn>>", "\\\\", " ", "\n", "assistant", "<turn>assistant<text>x</turn>\n", "<|endoftext|>", "é", "😀", "中", "'ll", "  "]
    texts = [t for t in odd_texts() if t is None or len(t) < 5000] + ["".join(r.choice(nasty) for _ in range(r.randint(1, 25))) for _ in range(60)]
    roles = ["user", "assistant", "assistant", "system", None, "", "<turn>", "assistant ", "a\nb<text>"]
    rows = [(c, r.choice([0, 1, 2, 3, 3, 3, None]), r.choice(roles), r.choice(texts)) for c in range(convs) for _ in range(r.randint(1, 14))]
    rows += [(None, 1, "assistant", "no conversation"), (None, 0, "user", None), rows[0], rows[0], (77, 5, "assistant", None), (78, 1, "assistant", ""), (78, 2, "user", "x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 3, "f", 1, True) for x in rows], SCHEMA).repartition(4)


def read(spark, rows, **options):
    return chat.read_back(chat.format_conversations(frame(spark, rows), PATH, **options), PATH).drop("n_tokens")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_rows(op11_chat(spark, f"{TESTDATA}/sf0.01"), brute(rows + PROBE))


def test_odd_rows(spark):
    rows = odd_rows() + PROBE
    same_rows(read(spark, rows), brute(rows))


def test_long_conversations_come_in_parts(spark):
    """A third of all rows in one conversation: many parts, the same digests, and the tokens of the whole."""
    rows = odd_rows(convs=6) + [(500, i // 3, ("user", "assistant")[i % 2], f"turn {i} </turn> <\\text> " * (i % 7)) for i in range(600)]
    formatted = chat.format_conversations(frame(spark, rows), PATH, split_chars=2000, part_chars=700)
    parts = [r for r in formatted.collect() if r.conv_id == 500]
    assert len(parts) > 20 and min(r.part for r in parts) > 0
    same_rows(chat.read_back(formatted, PATH).drop("n_tokens"), brute(rows))
    whole = next(r for r in chat.format_conversations(frame(spark, rows), PATH).collect() if r.conv_id == 500)
    parts.sort(key=lambda r: r.part)
    assert whole.part == 0 and "".join(r.formatted for r in parts) == whole.formatted
    assert [i for r in parts for i in r.ids] == whole.ids
    assert [m for r in parts for m in r.loss] == whole.loss


def test_offsets_and_masks(spark):
    """The ids are those of the whole text with control strings as tokens; a token is learnt if and only if its characters are an assistant's."""
    rows = odd_rows(seed=9, convs=5)
    encode = chat.Encoder(PATH)
    for r in chat.format_conversations(frame(spark, rows), PATH).collect():
        assert encode.tokenizer.decode(r.ids, skip_special_tokens=False) == r.formatted
        spans, at = [], 0
        for role, text in chat.read_turns(r.formatted):
            first = at + len(f"<turn>{chat.escape(role)}<text>")
            at = first + len(chat.escape(text)) + len("</turn>\n")
            if role == "assistant":
                spans.append((first, at - len("</turn>\n")))
        held = [any(a < e and s < b for a, b in spans) for s, e in zip(r.starts, r.ends)]
        assert held == r.loss
        for m, s, e in zip(r.loss, r.starts, r.ends):
            assert not m or any(a <= s and e <= b for a, b in spans)
        covered = sorted({i for m, s, e in zip(r.loss, r.starts, r.ends) if m for i in range(s, e)})
        assert covered == [i for a, b in spans for i in range(a, b)]


def test_loss_mask_by_search():
    r = random.Random(1)
    for _ in range(200):
        starts, ends, at = [], [], 0
        for _ in range(r.randrange(12)):
            size = r.randint(1, 4)
            for _ in range(r.choice([1, 1, 3])):  # tokens of one character's bytes have the same offsets
                starts.append(at)
                ends.append(at + size)
            at += size
        edges = sorted(r.sample(range(at + 1), min(at + 1, 2 * r.randrange(4)) // 2 * 2))
        spans = list(zip(edges[::2], edges[1::2]))
        mask = chat.loss_mask(np.array(starts, np.int64), np.array(ends, np.int64), spans)
        assert mask.tolist() == [any(a < e and s < b for a, b in spans) for s, e in zip(starts, ends)]


def test_escapes_come_back():
    r = random.Random(2)
    for _ in range(5000):
        text = "".join(r.choice(["<", "\\", "turn>", "/turn>", "text>", "t", ">", "\n"]) for _ in range(r.randrange(10)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_broken_output_is_noticed():
    for text in ("<turn>user<text>x", "x<turn>user<text>x</turn>\n", "<turn>user<text>x</turn>\n "):
        with pytest.raises(ValueError):
            chat.read_turns(text)


def test_no_conversations(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(rows, PATH), PATH).count() == 0
    assert [r.conv_id for r in chat.read_back(chat.format_conversations(chat.with_probe(rows), PATH), PATH).collect()] == [-7]
