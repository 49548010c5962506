"""Histories cut where the source is full: the same rows as whole histories, linear in the turns."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import conversation, instruct
from corpusloom.operators.tokenize import WordTokenizer
from corpusloom.operators.vocab import word_vocab

SCHEMA = "conv_id long, turn long, role string, text string"


def turns(sizes):
    rows = []
    for conv, n in sizes.items():
        for i in range(n):
            role = "user" if i % 2 == 0 else "assistant"
            text = None if (i, conv) in ((2, 7), (5, 7)) else f"words of turn {i}, " * (1 + (i * 7 + (conv or 3)) % 4)
            rows.append((conv, i, role, text if i % 11 else text and text + "\n\n"))
        rows.append((conv, n, "system", "left out"))
    return rows


@pytest.mark.parametrize("limit", [1, 30, 75, 4_000])
def test_rows_equal_those_of_whole_histories(spark, limit):
    df = spark.createDataFrame(turns({1: 2, 2: 40, 7: 30, None: 24, 9: 1}), SCHEMA)
    tok = WordTokenizer(word_vocab(df.where("text is not null"), "text"))
    pairs = conversation.turn_pairs(df)
    whole = conversation.with_history(pairs, chunk=7)
    for form in ({}, {"turn_format": "Q{i}: {q} A: {a}", "separator": "\n", "first": 1}):
        head = conversation.with_head_history(pairs, limit, tok, chunk=7, **form)
        assert head.columns == whole.columns
        for make in (instruct.sft_bos, instruct.sft_prefix):
            rows = [sorted(map(tuple, make(d, limit, 20, tok, keep_source=("conv_id", "turn"), **form).collect()), key=repr) for d in (whole, head)]
            assert rows[0] == rows[1]


def test_a_head_ends_with_the_pair_that_fills_the_limit(spark):
    df = spark.createDataFrame(turns({1: 60}), SCHEMA)
    tok = WordTokenizer(word_vocab(df.where("text is not null"), "text"))
    rows = conversation.turns_to_instructions(df, limit=100, tokenizer=tok).select("turn", F.size("history").alias("n")).collect()
    sizes = [r.n for r in sorted(rows)]
    assert sizes[:3] == [0, 1, 2] and sizes == sorted(sizes) and max(sizes) < 8


def test_fifty_thousand_turns_of_one_conversation(spark):
    i = F.col("id")
    df = spark.range(100_000).select(
        F.lit(1).cast("long").alias("conv_id"),
        i.alias("turn"),
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("turn "), i.cast("string")).alias("text"),
    )
    tok = WordTokenizer(word_vocab(spark.createDataFrame([("turn round",)], "text string"), "text"))
    rows = conversation.turns_to_instructions(df, limit=64, tokenizer=tok)
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("history")).alias("longest"), F.sum(F.size("history")).alias("all")).first()
    assert found.n == 50_000 and found.longest <= 8 and found["all"] <= 8 * 50_000


def test_turns_must_end_in_white_space(spark):
    df = spark.createDataFrame(turns({1: 4}), SCHEMA)
    tok = WordTokenizer(word_vocab(df, "text"))
    with pytest.raises(ValueError):
        conversation.with_head_history(conversation.turn_pairs(df), 10, tok, separator="|")
    with pytest.raises(ValueError):
        conversation.turns_to_instructions(df, limit=10)
