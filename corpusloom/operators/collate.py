"""Mini-batches, padded ahead of training."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.draws import below, draw_int
from corpusloom.functions.sequences import IGNORE_INDEX, Specials, mask_pad, pad_right, take_field

# Shares of the chosen tokens that become the mask token and a random token.
MASK_SHARE, RANDOM_SHARE = 0.8, 0.1
MLM_PROBABILITY = 0.15


def mini_batches(df: DataFrame, batch_size: int, order: str = "row_idx") -> DataFrame:
    return df.withColumn("mini_batch_id", F.expr(f"{order} div {batch_size}"))


def pad_batch(
    df: DataFrame,
    batch_size: int,
    fills: dict[str, int],
    multiple_of: int | None = None,
    order: str = "row_idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Pad the list columns in ``fills`` to the longest row of the mini-batch.

    ``within`` as for ``pack``: with the range column of a row index aligned to the batch size the
    rows need not be shuffled again.
    """
    df = _with_longest(df, batch_size, next(iter(fills)), multiple_of, order, within)
    return _padded(df, fills)


def _with_longest(
    df: DataFrame, batch_size: int, lead: str, multiple_of: int | None, order: str, within: Sequence[str]
) -> DataFrame:
    df = mini_batches(df, batch_size, order)
    longest = F.max(F.size(lead)).over(Window.partitionBy(*within, "mini_batch_id"))
    if multiple_of:
        longest = (F.ceil(longest / multiple_of) * multiple_of).cast("int")
    return df.withColumn("__longest", longest)


def _padded(df: DataFrame, fills: dict[str, int]) -> DataFrame:
    return df.withColumns({c: pad_right(c, F.col("__longest"), fill) for c, fill in fills.items()}).drop("__longest")


def collate_clm(
    df: DataFrame,
    batch_size: int,
    specials: Specials,
    multiple_of: int | None = None,
    order: str = "row_idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Causal batches: ids padded, labels are the ids with pad ignored."""
    fills = {"input_ids": specials.pad} | ({"attention_mask": 0} if "attention_mask" in df.columns else {})
    out = pad_batch(df, batch_size, fills, multiple_of, order, within)
    return out.withColumn("labels", mask_pad("input_ids", specials.pad))


def collate_mlm(
    df: DataFrame,
    batch_size: int,
    specials: Specials,
    vocab_size: int,
    p: float = MLM_PROBABILITY,
    seed: int = 0,
    multiple_of: int | None = None,
    order: str = "row_idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Masked batches: masked at random, then padded; what pads is never chosen, so it needs no draw."""
    fills = {"input_ids": specials.pad, "special_tokens_mask": 1, "labels": IGNORE_INDEX}
    fills |= {"attention_mask": 0} if "attention_mask" in df.columns else {}
    df = _with_longest(df, batch_size, "input_ids", multiple_of, order, within)
    return _padded(mask_tokens(df, specials, vocab_size, p, seed, order), fills)


def mask_tokens(
    df: DataFrame,
    specials: Specials,
    vocab_size: int,
    p: float = MLM_PROBABILITY,
    seed: int = 0,
    key: str = "row_idx",
) -> DataFrame:
    """Choose ordinary tokens with probability ``p`` and hide them from the model.

    Labels hold the original id at chosen positions, else the ignore value. Of the chosen ones
    80 % become the mask id, 10 % a random id, 10 % stay. All draws come from
    ``md5(key, position, seed)``. Needs ``special_tokens_mask``.
    """
    # ``digest(key, position, seed)`` with all but the position joined outside; a null key is left out, as there.
    before, after = F.coalesce(F.concat(F.col(key).cast("string"), F.lit("-")), F.lit("")), F.lit(f"-{seed}")
    drawn = F.transform(
        "special_tokens_mask", lambda s, i: F.when(s == 0, F.md5(F.concat(before, i.cast("string"), after)))
    )

    def hidden(x: Column, h: Column) -> Column:
        kind = F.substring(h, 9, 8)
        return (
            F.when(h.isNull(), x)
            .when(below(kind, MASK_SHARE), F.lit(specials.mask))
            .when(below(kind, MASK_SHARE + RANDOM_SHARE), F.pmod(draw_int(h, 17), F.lit(vocab_size)).cast("int"))
            .otherwise(x)
        )

    return (
        df.withColumn("__h", F.transform(drawn, lambda h: F.when(below(h, p), h)))  # null where not chosen
        .withColumns(
            {
                "input_ids": F.zip_with("input_ids", "__h", hidden),
                "labels": F.zip_with("input_ids", "__h", lambda x, h: F.when(h.isNull(), IGNORE_INDEX).otherwise(x)),
            }
        )
        .drop("__h")
    )


def collate_fixed(
    df: DataFrame,
    batch_size: int,
    columns: Sequence[str] = ("input_ids", "labels"),
    order: str = "row_idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Stack the rows of a mini-batch, which must have one common length, in order."""
    size = F.size(columns[0])
    rows = mini_batches(df, batch_size, order).groupBy(*within, "mini_batch_id").agg(
        F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"),
        F.min(size).alias("lo"),
        F.max(size).alias("hi"),
    )
    checked = F.when(F.col("lo") == F.col("hi"), F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit("rows of different length in mini-batch "), F.col("mini_batch_id").cast("string")))
        .cast(rows.schema["rows"].dataType)
    )
    stacked = rows.select(*within, "mini_batch_id", checked.alias("rows"))
    return stacked.select(*within, "mini_batch_id", *[take_field("rows", c).alias(c) for c in columns])


COLLATORS: dict[str, Callable[..., DataFrame]] = {
    "causal": collate_clm,
    "masked": collate_mlm,
    "fixed": collate_fixed,
}


def collate(df: DataFrame, collator: str | Callable[..., DataFrame], *args, **options) -> DataFrame:
    """Run a collator given by name or as a function from DataFrame to DataFrame."""
    if callable(collator):
        return collator(df, *args, **options)
    if collator not in COLLATORS:
        raise KeyError(f"unknown collator {collator!r}, known: {', '.join(COLLATORS)}")
    return COLLATORS[collator](df, *args, **options)
