"""Round trips, digests against a plain version, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from countspark.llm import chat

BAD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "\\", "\\\\<|", "<\\|turn|>", "a\nb\r\n", "", "😀 <s> </s> [INST]", "<|end|>", "$1 \\1 &lt;", "\\E \\Q", "[[INST]] <<SYS>> <</SYS>>"]


def plain(turns):
    turns = sorted(turns, key=lambda t: ((t[0] is not None, t[0] or 0), t[1] or "", t[2] or ""))
    whole = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
    loss = "".join(x or "" for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_escapes(spark):
    rows = spark.createDataFrame([(t,) for t in BAD], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for c, n in ((1, 6), (2, 1), (3, 5), (-7, 2), (5, 9)):
        rows += [(c, i, ("user", "assistant")[i % 2], BAD[(c + i) % len(BAD)] + f" {i}") for i in range(n)]
    rows += [(6, 0, "assistant", None), (6, 1, None, "x"), (7, None, "system", "s"), (7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (None, 0, "user", "u"),
             (8, 0, "us<|text|>er\n", "q"), (8, 1, "assistant", "long \\ " * 200000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string, example int")


def test_digests(turns):
    want = {}
    for r in turns.collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = chat.chat_digest(chat.chat_examples(turns)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain(want[r["conv_id"]]), r["conv_id"]


def test_examples(turns):
    rows = sorted(chat.chat_examples(turns.where("conv_id = 3")).collect(), key=lambda r: r["example"])
    assert [r["n_turns"] for r in rows] == [2, 4, 5]
    for r in rows[:-1]:
        assert r["formatted"][r["loss_end"]:] == chat.END
        assert rows[-1]["formatted"].startswith(r["formatted"])
        assert r["formatted"][:r["loss_start"]].endswith(chat.HEAD + "assistant" + chat.SPLIT)
    assert rows[-1]["loss_start"] == rows[-1]["loss_end"]
    assert chat.chat_examples(turns.limit(0)).count() == 0 and chat.chat_digest(chat.chat_examples(turns.limit(0))).count() == 0
