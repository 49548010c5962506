import pytest
from pyspark.sql import functions as F

from corpusloom.functions.draws import below, digest, draw_unit
from corpusloom.functions.text import byte_level_words, is_blank, strip, words
from corpusloom.operators import templates
from corpusloom.operators.filters import drop_source, filter_blank, filter_pairs, resolve_text_column

BLANKS = ["", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ",
          " ", " ", " ", " ", " ", "　", " 　\t", "\x1c\x85"]
OTHERS = ["a", "​", "﻿", "\x00", "᠎", " x ", "　中"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("r")).first().r


def test_blank_is_what_python_calls_blank(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BLANKS + OTHERS)], "i int, text string")
    got = {r.i: r.b for r in df.select("i", is_blank("text").alias("b")).collect()}
    for i, t in enumerate(BLANKS + OTHERS):
        assert got[i] == (t == "" or t.isspace()), repr(t)
    kept = {r.i for r in filter_blank(df.union(spark.createDataFrame([(99, None)], "i int, text string"))).collect()}
    assert kept == {i for i, t in enumerate(BLANKS + OTHERS) if t and not t.isspace()}


@pytest.mark.parametrize("text", ["", "  a b\t", "　x　", "\x1cx\x85", "a\nb\n", "\n\n", "x​ "])
def test_strip_is_pythons_strip(spark, text):
    assert one(spark, text, strip(F.col("text"))) == text.strip()


def test_words(spark):
    assert one(spark, "Hello, WORLD! 你好 a1-b2", words("text")) == ["hello", ",", "world", "!", "你好", "a1", "-", "b2"]


@pytest.mark.parametrize("text", ["I'm here,  don't", " a\n\n b", "x  ", "tab\tend", "你好 世界　x", "12ab 3.5", "", "  "])
def test_byte_level_split_keeps_everything(spark, text):
    import regex

    want = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)
    got = one(spark, text, byte_level_words("text"))
    assert got == want and "".join(got) == text


def test_filter_pairs(spark):
    rows = [(0, "a", "b"), (1, "", "b"), (2, "a", None), (3, None, "b"), (4, " ", "b"), (5, "a", "")]
    df = spark.createDataFrame(rows, "i int, prompt string, response string")
    assert sorted(r.i for r in filter_pairs(df).collect()) == [0, 4]


def test_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, text string")
    assert resolve_text_column(df) == "text" and resolve_text_column(df.drop("text")) == "a"
    assert drop_source(df.withColumn("n", F.lit(1)), ["n"], ("a",)).columns == ["a", "n"]


def test_below_tells_the_same_as_the_number(spark):
    df = spark.range(2000).select(digest(F.col("id"), F.lit(1)).alias("h"))
    for share in (0.0, 0.15, 0.5, 0.999, 1.0):
        assert df.where(below(F.col("h"), share) != (draw_unit(F.col("h"), 1) < share)).count() == 0
    assert 0.12 < df.where(below(F.col("h"), 0.15)).count() / 2000 < 0.18


def render(spark, history, prompt="p", **form):
    df = spark.createDataFrame([(prompt, history)], "prompt string, history array<array<string>>")
    return df.select(templates.render_history("prompt", "history", **form).alias("r")).first().r


def test_history(spark):
    assert render(spark, []) == "[Round 0]\n问：p\n答："
    assert render(spark, None) == "[Round 0]\n问：p\n答："
    assert render(spark, []  , empty_as_bare=True) == "p"
    assert render(spark, [["q1", "a1"]]) == "[Round 0]\n问：q1\n答：a1\n[Round 1]\n问：p\n答："
    two = render(spark, [["q1", "a1"], ["q2", "a2"]], turn_format="({i}) {q} > {a}", separator="|", first=1)
    assert two == "(1) q1 > a1|(2) q2 > a2|(3) p > "
    df = spark.createDataFrame([("p",)], "prompt string")
    assert df.select(templates.render_history("prompt", None).alias("r")).first().r == "p"


def test_templates(spark):
    df = spark.createDataFrame([("do {x} {instruction}", "ok")], "prompt string, response string")
    assert templates.apply_template(df, "ziya_prompt").first().source == "<human>:do {x} {instruction}\n<bot>:"
    alpaca = templates.apply_template(df, "standard_alpaca").first()
    assert alpaca.source.endswith("### Instruction:\ndo {x} {instruction}\n\n### Response: ") and alpaca.target == "ok"
    assert templates.apply_template(df, "chat_prompt").first().source.endswith("User：do {x} {instruction}\nAssistant：")
    assert templates.apply_template(df, "chat_prompt_en").first().source.endswith("\nAssistant: ")
    assert templates.apply_template(df, "default", keep_source=("prompt",)).columns == ["prompt", "source", "target"]
    with pytest.raises(KeyError, match="unknown template"):
        templates.apply_template(df, "none")
    templates.register_template("shout", "!", "!")
    assert templates.apply_template(df, "shout").first().source == "!do {x} {instruction}!"
