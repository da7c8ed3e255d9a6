"""Conversations of many turns and of very long ones, through storage and back."""

import hashlib

from pyspark.sql import functions as F

from marklane.llm import chat


def test_long_conversations_and_turns(spark):
    long = "so [INST] it </s> was " * 40_000
    rows = [("many", i, ("user", "assistant")[i % 2], f"turn {i} [/INST]") for i in range(3000)] + [("long", 0, "user", long), ("long", 1, "assistant", long), ("odd", 0, None, None), ("odd", 0, "assistant", ""), (None, 5, "tool", "x")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(turns)).collect()}
    assert set(got) == {"many", "long", "odd", None} and (got["many"]["n_turns"], got["odd"]["n_turns"]) == (3000, 2)
    for conv in ("many", "long"):
        mine = [(role, text) for c, _, role, text in rows if c == conv]
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        said = "".join(t for r, t in mine if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_turns(turns.limit(0)).count() == 0
