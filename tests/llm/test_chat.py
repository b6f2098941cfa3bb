"""Conversations written and read back, with texts that try to break the format."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat
from millrace.llm.chat import END, START, format_conversations, parse, read_back, render

BITS = [
    START, END, "<|", "<\\|", "\\", "\\n", "\\p", "|", "<", "\n", "im_end|>", "assistant", "user", "é🙂", " ok",
    f"{END}\n{START}assistant\nyes{END}\n",
]


def test_what_is_written_reads_back():
    rng = random.Random(7)
    draw = lambda most: "".join(rng.choices(BITS, k=rng.randint(0, most)))
    for _ in range(3_000):
        turns = [(draw(3), draw(6)) for _ in range(rng.randint(0, 5))]
        written, found = render(turns)
        assert [(t.role, t.text) for t in found] == turns
        assert written.count(START) == written.count(END) == len(turns)
        assert all(chat.unescape_text(written[t.start : t.end]) == t.text for t in found)


def test_ordinary_texts_are_not_escaped():
    turns = [("user", "a <b> | c\\d <| e"), ("assistant", "plain\n\ntext")]
    assert render(turns)[0] == f"{START}user\na <b> | c\\d <| e{END}\n{START}assistant\nplain\n\ntext{END}\n"


@pytest.mark.parametrize(
    "broken",
    ["x", START, f"{START}user", f"{START}user\nhi", f"{START}user\nhi{END}", f"{START}a\n{START}b\n{END}\n", f"{START}{END}\n{END}\n"],
)
def test_grammar_refuses(broken):
    assert parse(broken) is None


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|> no"), (1, 2, "assistant", "tie"),
    (1, None, "assistant", "last"), (2, 5, None, ""), (2, 3, "assistant", ""), (None, 1, "assistant", "nobody's"),
    (None, 0, "user", "who?"), (3, 0, "assistant", "x" * 200_000), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"),
    (4, 0, "a\nb\\|", "hm"), (-1, 0, "user", "<\\|im_end|>"),
]


def conversations(spark, rows):
    wide = [(c, t, r, x, 1, 2, "n") for c, t, r, x in rows]
    return spark.createDataFrame(
        wide, "conv_id long, turn int, role string, text string, place int, part long, tie string"
    )


def expected(spark, rows):
    """One row a conversation, by hand; ties are ordered by the hash that the text documents."""
    frame = spark.createDataFrame(
        [(c, t, r or "", x or "") for c, t, r, x in rows], "c long, t int, r string, x string"
    )
    ordered = sorted(
        frame.withColumn("h", F.xxhash64("r", "x")).collect(), key=lambda r: (r["t"] is None, r["t"] or 0, r["h"])
    )
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    result = {}
    for conv in {r["c"] for r in ordered}:
        turns = [(r["r"], r["x"]) for r in ordered if r["c"] == conv]
        learnt = "".join(x for r, x in turns if r == "assistant")
        result[conv] = (
            len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learnt), sha(learnt), len(render(turns)[0]),
        )
    return result


@pytest.mark.parametrize("part", [1 << 16, 20])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    frame = conversations(spark, ROWS)
    got = {r["conv_id"]: tuple(r)[1:] for r in read_back(format_conversations(frame)).collect()}
    assert got == expected(spark, ROWS)


def test_parts_hold_the_texts_and_a_hot_conversation_is_spread(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "z" * 50) for i in range(4_000)]
    rows += [(i, 0, "assistant", "hi") for i in range(20)]
    parts = format_conversations(conversations(spark, rows)).collect()
    hot = sorted((p for p in parts if p["conv_id"] == 7), key=lambda p: (p["place"], p["part"]))
    assert len({p["place"] for p in hot}) > 1
    turns = [(t.role, t.text) for p in hot for t in parse(p["text"])]
    assert sorted(turns) == sorted((r, x) for c, _, r, x in rows if c == 7)
    learnt = [p["text"][s["start"] : s["end"]] for p in hot for s in p["loss"]]
    assert learnt[-1] == "turn 3999 " + "z" * 50 and "hi" in learnt[:6]
    got = {r["conv_id"]: tuple(r)[1:] for r in read_back(format_conversations(conversations(spark, rows))).collect()}
    assert got == expected(spark, rows)


def test_no_rows(spark):
    empty = conversations(spark, ROWS).limit(0)
    assert format_conversations(empty).collect() == []
    assert read_back(format_conversations(empty)).collect() == []
