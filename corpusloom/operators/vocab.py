"""Vocabulary tables: building, merging, reporting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.sequences import Specials, as_col
from corpusloom.functions.text import words
from corpusloom.operators.order import with_row_index
from corpusloom.session import cut_lineage

MAX_RANKED_IN_ONE_TASK = 1_000_000


def token_counts(df: DataFrame, text: str | Column, split: Callable[[Column], Column] = words) -> DataFrame:
    """``(token, n)`` over the corpus; counted on the map side first, so frequent words are no skew."""
    return df.select(F.explode(split(as_col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def word_vocab(
    df: DataFrame,
    text: str | Column,
    vocab_size: int | None = None,
    specials: Specials = Specials(),
    split: Callable[[Column], Column] = words,
) -> DataFrame:
    """``(token, id)``: ids by falling count, then token, starting after the special tokens.

    ``vocab_size`` is the size of the tokenizer to build; None keeps every word of the corpus. The
    table is written to the shared folder once, as every reader would else count the corpus again.
    """
    counts = token_counts(df, text, split)
    first = specials.first_free
    if vocab_size is not None and vocab_size <= MAX_RANKED_IN_ONE_TASK:
        top = counts.orderBy(F.desc("n"), "token").limit(vocab_size)
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
        ranked = top.select("token", (rank - 1 + first).cast("int").alias("id"))
        return cut_lineage(ranked, "vocab")
    ranked = with_row_index(cut_lineage(counts, "counts"), [-F.col("n"), "token"], "rank")
    if vocab_size is not None:
        ranked = ranked.where(F.col("rank") < vocab_size)
    return cut_lineage(ranked.select("token", (F.col("rank") + first).cast("int").alias("id")), "vocab")


def merge_vocab(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Tokens of ``extra`` not in ``base`` get ids after the largest one, in their own order."""
    top = base.agg(F.max("id")).first()[0]
    start = 0 if top is None else top + 1
    new = with_row_index(extra.join(base.select("token"), "token", "left_anti").select("token", "id"), "id", "rank")
    return base.select("token", "id").unionByName(
        new.select("token", (F.col("rank") + start).cast(base.schema["id"].dataType).alias("id"))
    )


def merge_merges(base: DataFrame, extra: DataFrame, dedupe: bool = False) -> DataFrame:
    """Append a merge list to another; the order of both is kept.

    A merge is two symbols with one blank between them, so a blank inside a symbol is an error.
    ``dedupe`` leaves out merges that ``base`` has already.
    """
    top = base.agg(F.max("rank")).first()[0]
    start = 0 if top is None else top + 1
    if dedupe:
        extra = extra.join(base.select("left", "right"), ["left", "right"], "left_anti")
        extra = with_row_index(extra, "rank", "rank_new").withColumn("rank", F.col("rank_new"))
    merge = F.concat_ws(" ", "left", "right")
    sound = F.regexp_count(merge, F.lit(" ")) <= 1
    left = F.when(sound, F.col("left")).otherwise(
        F.raise_error(F.concat(F.lit("more than one blank in merge: "), merge)).cast("string")
    )
    dtype = base.schema["rank"].dataType
    added = extra.select((F.col("rank") + start).cast(dtype).alias("rank"), left.alias("left"), "right")
    return base.select("rank", "left", "right").unionByName(added)


def vocab_report(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Old size, new size and number of added tokens in one row."""
    sizes = base.select(F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        merged.select(F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    old = F.coalesce(F.sum("old"), F.lit(0)).cast("bigint")
    new = F.coalesce(F.sum("new"), F.lit(0)).cast("bigint")
    return sizes.agg(old.alias("old_size"), new.alias("new_size"), (new - old).alias("added"))
