"""Row filters and column choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import is_blank, non_empty


def resolve_text_column(df: DataFrame) -> str:
    """``text`` if there is such a column, else the first one."""
    return "text" if "text" in df.columns else df.columns[0]


def drop_source(df: DataFrame, built: list[str], keep_source: tuple[str, ...] = ()) -> DataFrame:
    """Keep the built columns and the named source columns only."""
    return df.select(*keep_source, *[c for c in built if c not in keep_source])


def filter_pairs(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Rows with a prompt and a response; a single blank counts as text."""
    return df.where(non_empty(prompt) & non_empty(response))


def filter_blank(df: DataFrame, text: str | Column = "text") -> DataFrame:
    """Rows whose text is neither null, empty nor all white space."""
    return df.where(F.coalesce(~is_blank(text), F.lit(False)))
