"""Chat formatting and its inverse."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from twinpath.llm import chat, queries

MARKS = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<<|", "<\\\\|x", "<<SYS>>\\<", "[\\INST][INST]", "a\nb", "", "<s><", "|im_sep|>", "é<|"]


def test_escaping_is_undone(spark):
    df = spark.createDataFrame([(m,) for m in MARKS + ["".join(MARKS)]], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] for r in rows)
    assert not any(mark in r["e"] for r in rows for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.formatted(df)
    return {r["conv_id"]: r for r in made.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "segments").collect()}


def test_turns_merge_and_come_back(spark):
    rows = [(1, 2, "assistant", "c", "x"), (1, 0, "user", "a", "x"), (1, 1, "user", "b", "x"), (1, 3, "assistant", None, "x"), (1, 4, "user", "d", "x"), (None, None, None, "e", "x"), (2, 0, "assistant", "t", "x"), (2, 0, "assistant", "t", "x")]
    found = read_back(spark, rows)
    assert found[1]["formatted"] == "<|im_start|>user<|im_sep|>a<|im_turn|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_turn|><|im_end|><|im_start|>user<|im_sep|>d<|im_end|>"
    assert [tuple(t) for t in found[1]["turns"]] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", ""), ("user", "d")]
    assert found[1]["loss"] == "c" and found[2]["loss"] == "tt"
    assert [tuple(t) for t in found[None]["turns"]] == [("", "e")]
    assert "".join(s["text"] for s in found[1]["segments"]) == found[1]["formatted"]


@pytest.mark.parametrize("role", ["user", "assistant", "<|im_sep|>", "a\nb", ""])
def test_any_text_under_any_role(spark, role):
    rows = [(1, i, role, m, "") for i, m in enumerate(MARKS)]
    assert [tuple(t) for t in read_back(spark, rows)[1]["turns"]] == [(role, m) for m in MARKS]


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_against_brute_force(spark, tables):
    turns = {}
    for r in spark.read.parquet(f"{tables}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", MARKS[0]), ("assistant", MARKS[0])]
    rows = queries.op4_chat(spark, tables).collect()
    assert {r["conv_id"] for r in rows} == set(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
