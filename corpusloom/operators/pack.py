"""Rows of token ids to blocks of equal length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.sequences import add_special, take_field
from corpusloom.operators.filters import filter_blank
from corpusloom.operators.tokenize import Tokenizer, encode

DEFAULT_BLOCK_CAP = 1_024
BATCH_ROWS = 1_000
GROUP_ROWS = 65_536


def resolve_block_size(given: int | None, model_max_length: int) -> int:
    """Given size, at most the model limit; without one the limit, at most 1,024."""
    if given is None:
        return min(model_max_length, DEFAULT_BLOCK_CAP)
    return min(given, model_max_length)


def _pieces(df: DataFrame, cols: Sequence[str], block: int, kept: Column, group: list[str], order: str) -> DataFrame:
    """Cut rows at block borders and collect the pieces of each block.

    Needs ``start`` and ``end``, the token positions of the row in its group. Rows are cut, never
    exploded into tokens, and one output row holds one block at most.
    """
    lo, hi = F.greatest(F.col("start"), F.col("block_id") * block), F.least("end", "kept", (F.col("block_id") + 1) * block)
    cutting = [
        F.slice(F.col(c), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias(c) for c in cols
    ]
    first, last = F.expr(f"start div {block}"), F.expr(f"(least(end, kept) - 1) div {block}")
    cut_rows = (
        df.withColumn("kept", kept)
        .where((F.col("n") > 0) & (F.col("start") < F.col("kept")))
        .withColumn("block_id", F.explode(F.sequence(first, last)))
    )
    gathered = (
        cut_rows.select(*group, "block_id", F.struct(order, *cutting).alias("piece"))
        .groupBy(*group, "block_id")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    )
    return gathered.select(
        *group, "block_id", *[F.flatten(take_field("pieces", c)).alias(c) for c in cols]
    )


def pack(
    df: DataFrame,
    block_size: int,
    batch_rows: int | None = BATCH_ROWS,
    labels: bool = True,
    keep_short: bool = True,
    columns: Sequence[str] | None = None,
    order: str = "row_idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Concatenate the rows of a batch and cut blocks of ``block_size``; the rest is dropped.

    A batch with fewer tokens than one block is kept as one short block unless ``keep_short`` is
    off. Every list column is cut alike. ``within`` names columns a batch never crosses, such as
    the split, or the range column of an aligned row index, which then saves the shuffle by batch.
    ``batch_rows=None`` packs the whole table as one batch.
    """
    cols = list(columns or [c for c, t in df.dtypes if t.startswith("array<") and c not in within])
    lead = cols[0]
    whole = F.when(F.lit(keep_short) & (F.col("total") < block_size), F.col("total")).otherwise(
        F.expr(f"total div {block_size} * {block_size}")
    )
    rows = df.select(*within, order, F.size(lead).cast("bigint").alias("n"), *cols)
    if batch_rows is None:
        out = _pieces(_global_positions(rows, order, list(within)), cols, block_size, whole, list(within), order)
    else:
        group = [*within, "batch_id"]
        batch = Window.partitionBy(*group).orderBy(order)
        everything = batch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = (
            rows.withColumn("batch_id", F.expr(f"{order} div {batch_rows}"))
            .withColumn("end", F.sum("n").over(batch.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("total", F.sum("n").over(everything))
            .withColumn("start", F.col("end") - F.col("n"))
        )
        out = _pieces(rows, cols, block_size, whole, group, order)
    return out.withColumn("labels", F.col(lead)) if labels else out


def _global_positions(rows: DataFrame, order: str, within: list[str]) -> DataFrame:
    """Token positions over the whole table: sums inside groups of rows plus the sums before.

    The table of group sums has one row per 65,536 input rows.
    """
    rows = rows.withColumn("grp", F.expr(f"{order} div {GROUP_ROWS}"))
    sums = rows.groupBy(*within, "grp").agg(F.sum("n").alias("gsum"))
    one = F.lit(0) if not within else None
    part = Window.partitionBy(*(within or [one])).orderBy("grp")
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    every = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        *within,
        "grp",
        F.coalesce(F.sum("gsum").over(before), F.lit(0)).alias("before"),
        F.sum("gsum").over(every).alias("total"),
    )
    inside = Window.partitionBy(*within, "grp").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("run", F.sum("n").over(inside))
        .join(sums, [*within, "grp"])
        .withColumn("end", F.col("before") + F.col("run"))
        .withColumn("start", F.col("end") - F.col("n"))
    )


def truncate_rows(
    df: DataFrame, text: str | Column, block_size: int, tokenizer: Tokenizer, keep_source: tuple[str, ...] = (), key=None
) -> DataFrame:
    """One row per text: cut to ``block_size - 1`` ids, then specials in the prefix layout."""
    out = encode(
        df, text, tokenizer, max_length=block_size - 1, attention_mask=False, keep_source=keep_source, key=key
    )
    return out.withColumn("input_ids", add_special("input_ids", tokenizer.specials, "prefix"))


def line_rows(
    df: DataFrame,
    text: str,
    max_length: int,
    tokenizer: Tokenizer,
    pad_to_max: bool = False,
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
) -> DataFrame:
    """One row per non-blank line with specials, cut and optionally padded to ``max_length``."""
    return encode(
        filter_blank(df, text),
        text,
        tokenizer,
        special=True,
        max_length=max_length,
        pad_to=max_length if pad_to_max else None,
        special_mask=True,
        keep_source=keep_source,
        key=key,
    )
