"""Instruction rows: source and target to ``input_ids`` and ``labels``.

Each layout is a pair of Column functions over the two id lists, so the same code runs on batch
and streaming frames. No row is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.sequences import (
    IGNORE_INDEX,
    Specials,
    add_special,
    add_special_pair,
    as_col,
    cut,
    ids_of,
    mask_pad,
    pad_right,
    proportional_budget,
    repeat,
)
from corpusloom.operators.filters import filter_pairs
from corpusloom.operators.templates import render_history
from corpusloom.operators.tokenize import Tokenizer


def _two_sides(df, source, target, tokenizer, keep_source, key) -> DataFrame:
    keep = list(dict.fromkeys([*keep_source, *([key] if key else [])]))
    df = df.select(*keep, as_col(source).alias("__s"), as_col(target).alias("__t"))
    return tokenizer.with_ids(df, {"__a": "__s", "__b": "__t"}, key).drop("__s", "__t")


def _finish(df: DataFrame, keep_source: tuple[str, ...]) -> DataFrame:
    return df.select(*keep_source, "input_ids", "labels")


def sft_llama(
    df: DataFrame,
    max_source: int,
    max_target: int,
    tokenizer: Tokenizer,
    source: str | Column = "source",
    target: str | Column = "target",
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
) -> DataFrame:
    """``[bos] s t [eos]`` padded to ``max_source + max_target``.

    Sides are cut, to one below their limit, only if both together are too long. Labels ignore the
    source and the padding.
    """
    sp, total = tokenizer.specials, max_source + max_target
    df = _two_sides(df, source, target, tokenizer, keep_source, key)
    too_long = F.size("__a") + F.size("__b") > total - 2
    df = df.withColumns(
        {
            "__a": F.concat(ids_of(sp.bos), F.when(too_long, cut("__a", max_source - 1)).otherwise(F.col("__a"))),
            "__b": F.concat(F.when(too_long, cut("__b", max_target - 1)).otherwise(F.col("__b")), ids_of(sp.eos)),
        }
    )
    ids = pad_right(F.concat("__a", "__b"), total, sp.pad)
    labels = pad_right(F.concat(repeat(IGNORE_INDEX, F.size("__a")), "__b"), total, IGNORE_INDEX)
    return _finish(df.withColumns({"input_ids": ids, "labels": labels}), keep_source)


def sft_halves(
    df: DataFrame,
    max_source: int,
    max_target: int,
    tokenizer: Tokenizer,
    source: str | Column = "source",
    target: str | Column = "target",
    special: bool | str = "sentence",
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
) -> DataFrame:
    """Two halves, each cut and padded to one below its limit; the target padding stays in the labels.

    Kept for completeness: ``sft_llama`` is the layout to use.
    """
    sp = tokenizer.specials
    df = _two_sides(df, source, target, tokenizer, keep_source, key)

    def half(side: str, length: int) -> Column:
        ids = cut(side, length - (2 if special else 0))
        ids = add_special(ids, sp, "sentence" if special is True else special) if special else ids
        return pad_right(ids, length, sp.pad)

    df = df.withColumns({"__a": half("__a", max_source - 1), "__b": half("__b", max_target - 1)})
    labels = F.concat(repeat(IGNORE_INDEX, F.size("__a")), "__b")
    return _finish(df.withColumns({"input_ids": F.concat("__a", "__b"), "labels": labels}), keep_source)


def _limits(max_source: int, max_target: int, max_length: int | None) -> tuple[Column, Column, int]:
    if max_length is None:
        return F.lit(max_source), F.lit(max_target), max_source + max_target
    return *proportional_budget(F.size("__a"), F.size("__b"), max_length), max_length


def sft_bos(
    df: DataFrame,
    max_source: int,
    max_target: int,
    tokenizer: Tokenizer,
    prompt: str = "prompt",
    response: str = "response",
    history: str | None = "history",
    max_length: int | None = None,
    ignore_pad: bool = True,
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
    **form,
) -> DataFrame:
    """``a [mask] [bos] b [eos]``; labels begin at ``bos``.

    Rows without prompt or response are left out. With ``max_length`` the two limits are shares of
    it in proportion to the lengths of the sides.
    """
    sp = tokenizer.specials
    pairs = filter_pairs(df, prompt, response)
    df = _two_sides(pairs, render_history(prompt, history, **form), response, tokenizer, keep_source, key)
    limit_a, limit_b, total = _limits(max_source, max_target, max_length)
    df = df.withColumns({"__la": limit_a, "__lb": limit_b})
    df = df.withColumns({"__a": cut("__a", F.col("__la") - 1), "__b": cut("__b", F.col("__lb") - 2)})
    df = df.withColumn("__x", add_special_pair("__a", "__b", sp))
    context = (F.array_position("__x", sp.bos) - 1).cast("int")
    labels = F.concat(repeat(IGNORE_INDEX, context), F.slice("__x", context + 1, F.size("__x") - context))
    labels = pad_right(labels, total, sp.pad)
    return _finish(
        df.withColumns(
            {"input_ids": pad_right("__x", total, sp.pad), "labels": mask_pad(labels, sp.pad) if ignore_pad else labels}
        ),
        keep_source,
    )


def sft_prefix(
    df: DataFrame,
    max_source: int,
    max_target: int,
    tokenizer: Tokenizer,
    prompt: str = "prompt",
    response: str = "response",
    history: str | None = "history",
    max_length: int | None = None,
    ignore_pad: bool = True,
    strict: bool = False,
    special: str = "prefix",
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
    **form,
) -> DataFrame:
    """Source with its specials cut to the limit, target, ``[eos]``; labels are pad over the source.

    A full source and a full target make a row one longer than the two limits; ``strict`` cuts the
    target one shorter.
    """
    sp = tokenizer.specials
    pairs = filter_pairs(df, prompt, response)
    df = _two_sides(pairs, render_history(prompt, history, **form), response, tokenizer, keep_source, key)
    limit_a, limit_b, total = _limits(max_source, max_target, max_length)
    df = df.withColumns({"__la": limit_a, "__lb": limit_b})
    df = df.withColumns(
        {
            "__a": add_special(cut("__a", F.col("__la") - 2), sp, special),
            "__b": F.concat(cut("__b", F.col("__lb") - (1 if strict else 0)), ids_of(sp.eos)),
        }
    )
    ids = pad_right(F.concat("__a", "__b"), total, sp.pad)
    labels = pad_right(F.concat(repeat(sp.pad, F.size("__a")), "__b"), total, sp.pad)
    return _finish(
        df.withColumns({"input_ids": ids, "labels": mask_pad(labels, sp.pad) if ignore_pad else labels}), keep_source
    )


def seq2seq_rows(
    df: DataFrame,
    max_source: int,
    max_target: int,
    tokenizer: Tokenizer,
    prompt: str = "prompt",
    response: str = "response",
    history: str | None = "history",
    order: str = "row_idx",
    batch_rows: int = 1_000,
    special: str = "prefix",
    ignore_pad: bool = True,
    keep_source: tuple[str, ...] = (),
    within: tuple[str, ...] = (),
    **form,
) -> DataFrame:
    """Evaluation rows: source as ``input_ids`` padded within its batch, target as ``labels``.

    Batches are ``batch_rows`` consecutive rows; dropped pairs leave their batch smaller.
    ``within`` names the range column of an index aligned to the batches.
    """
    sp = tokenizer.specials
    keep = tuple(dict.fromkeys([*keep_source, *within, order]))
    pairs = filter_pairs(df, prompt, response)
    source = render_history(prompt, history, empty_as_bare=True, **form)
    df = _two_sides(pairs, source, response, tokenizer, keep, order)
    df = df.withColumns(
        {
            "batch_id": F.expr(f"{order} div {batch_rows}"),
            "__a": add_special(cut("__a", max_source - 2), sp, special),
            "__b": add_special(cut("__b", max_target - 2), sp, special),
        }
    )
    batch = Window.partitionBy(*within, "batch_id")
    labels = mask_pad("__b", sp.pad) if ignore_pad else F.col("__b")
    df = df.withColumn("longest", F.max(F.size("__a")).over(batch)).withColumns(
        {
            "attention_mask": pad_right(F.array_repeat(F.lit(1), F.size("__a")), F.col("longest"), 0),
            "input_ids": pad_right("__a", F.col("longest"), sp.pad),
            "labels": labels,
        }
    )
    return df.select(*keep, "batch_id", "input_ids", "attention_mask", "labels")


def check_sequences(df: DataFrame, length: int, exact: bool = True, fail: bool = False) -> DataFrame:
    """Count rows whose lists differ in length or miss the wanted length; raise with ``fail``."""
    size, labels = F.size("input_ids"), F.size("labels")
    wrong = (size != length) if exact else (size > length)
    report = df.agg(
        F.count("*").alias("rows"),
        F.count_if(size != labels).alias("unequal"),
        F.count_if(wrong).alias("wrong_length"),
    )
    if fail:
        row = report.first()
        if row.unequal or row.wrong_length:
            raise ValueError(f"{row.unequal} rows with unequal lists, {row.wrong_length} of wrong length")
    return report
