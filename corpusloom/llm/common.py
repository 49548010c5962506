"""Small Column helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it.

    Inside a lambda of a higher-order function a plain Column would be evaluated for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def group_key(*cols: str) -> Column:
    """One non-null string for the values of ``cols``; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in cols]
    return F.concat_ws("\x00", *parts)


def windows_hash(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order; none if there are fewer words."""
    runs = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return F.transform(
        F.slice(words, F.lit(1), runs),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]),
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
