"""Preparation from source table to training rows, and batch prediction, in the usual order of steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.sequences import add_special
from corpusloom.operators import instruct
from corpusloom.operators.filters import filter_blank, resolve_text_column
from corpusloom.operators.order import Keys, in_percent_head, take_head, with_row_index
from corpusloom.operators.pack import BATCH_ROWS, pack, resolve_block_size
from corpusloom.operators.predict import EOS_MARK, ScorerFactory, clean_answer, predict, route
from corpusloom.operators.templates import apply_template, template
from corpusloom.operators.tokenize import Tokenizer, encode
from corpusloom.session import cut_lineage
from corpusloom.sources import read_jsonl, write_jsonl

DEFAULT_PERCENT = 5
Caps = dict[str, int | None]

STYLES: dict[str, Callable[..., DataFrame]] = {
    "llama": instruct.sft_llama,
    "halves": instruct.sft_halves,
    "bos": instruct.sft_bos,
    "prefix": instruct.sft_prefix,
}


def split_parts(df: DataFrame, pct: int, order_by: Keys, wanted: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """One frame per split; without a validation split, the first ``pct`` percent of train become it.

    The parts are plain key filters on the input, so a sorted source is not read twice in full.
    Only the ``wanted`` splits are looked for; without them, all there are.
    """
    parts: dict[str, DataFrame] = {}
    if "split" in df.columns:
        names = df.select("split").where(F.col("split").isNotNull())
        if wanted is not None:
            names = names.where(F.col("split").isin("train", "validation", *wanted))
        parts = {r.split: df.where(F.col("split") == r.split).drop("split") for r in names.distinct().collect()}
        if "validation" in parts or "train" not in parts:
            return parts
        df = parts["train"]
    head = in_percent_head(df, pct, order_by)
    return parts | {"train": df.where(~head), "validation": df.where(head)}


def pretrain_rows(
    df: DataFrame,
    tokenizer: Tokenizer,
    order_by: str,
    kind: str = "causal",
    block_size: int | None = None,
    pct: int = DEFAULT_PERCENT,
    caps: Caps | None = None,
    batch_rows: int | None = BATCH_ROWS,
    special: bool | str = False,
    pad_to_max: bool = False,
    keep_short: bool = True,
    splits: tuple[str, ...] = ("train", "validation"),
) -> DataFrame:
    """Raw text rows to pretraining rows with a ``split`` column.

    Kinds: ``causal`` and ``masked`` pack (masked rows carry a special mask and no labels),
    ``lines`` makes one masked row per non-blank line, ``truncated`` one causal row per text.
    ``order_by`` is a unique column that gives the order of the corpus. Caps count finished rows.
    """
    if kind not in ("causal", "masked", "lines", "truncated"):
        raise ValueError(f"unknown kind {kind!r}")
    block = resolve_block_size(block_size, tokenizer.model_max_length)
    text = resolve_text_column(df.drop("split", order_by))
    masked = kind in ("masked", "lines")
    wanted = special or ("sentence" if masked else False)
    cut = {"lines": block, "truncated": block - 1}.get(kind)
    parts = split_parts(df.select(order_by, text, *(["split"] if "split" in df.columns else [])), pct, order_by, splits)

    def build(rows: DataFrame) -> DataFrame:
        if kind == "lines":
            rows = filter_blank(rows, text)
        ids = encode(
            rows,
            text,
            tokenizer,
            special=False if kind == "truncated" else wanted,
            max_length=cut,
            pad_to=block if kind == "lines" and pad_to_max else None,
            special_mask=masked,
            attention_mask=kind != "truncated",
            keep_source=(order_by,),
            key=order_by,
        )
        if kind == "truncated":
            ids = ids.withColumn("input_ids", add_special("input_ids", tokenizer.specials, "prefix"))
        if kind == "lines":
            # Which lines are left is known from their text only.
            ids = cut_lineage(ids, "lines")
        if kind in ("lines", "truncated"):
            return with_row_index(ids, order_by).drop(order_by)
        indexed = with_row_index(ids, order_by, align=batch_rows, range_col="rng").drop(order_by)
        within = ("rng",) if batch_rows else ()
        blocks = pack(indexed.drop(*([] if within else ["rng"])), block, batch_rows, kind == "causal", keep_short, within=within)
        return blocks.drop("rng")

    order = "row_idx" if kind in ("lines", "truncated") else ["batch_id", "block_id"] if batch_rows else "block_id"
    out = []
    for split in splits:
        if split not in parts:
            raise ValueError(f"split {split!r} is needed but missing")
        rows, cap = build(parts[split]), (caps or {}).get(split)
        # The head looks for its border first and then reads the rows again.
        rows = rows if cap is None else take_head(cut_lineage(rows, "capped"), cap, order_by=order)
        out.append(rows.withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, out)


def instruction_rows(
    df: DataFrame,
    tokenizer: Tokenizer,
    style: str = "llama",
    max_source: int = 1_024,
    max_target: int = 128,
    prompt_type: str = "default",
    caps: Caps | None = None,
    order_by: Keys = "row_idx",
    keep_source: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Instruction rows of a frame with a ``split`` column.

    ``llama`` and ``halves`` take a template; ``bos`` and ``prefix`` render the history. Caps are
    applied to the source rows for ``bos`` and ``prefix``, which drop rows without text afterwards;
    the other styles keep every row, so the order of the two steps does not matter for them.
    """
    if style not in STYLES:
        raise KeyError(f"unknown style {style!r}, known: {', '.join(STYLES)}")
    if caps:
        capped = {split: cap for split, cap in caps.items() if cap is not None}
        others = df.where(F.col("split").isNull() | ~F.col("split").isin(*capped)) if capped else df
        heads = [take_head(df.where(F.col("split") == split), cap, order_by=order_by) for split, cap in capped.items()]
        df = reduce(DataFrame.unionByName, heads, others)
    keep = tuple(dict.fromkeys([*keep_source, *(["split"] if "split" in df.columns else [])]))
    if style in ("llama", "halves"):
        df = apply_template(df, prompt_type, keep_source=keep)
    return STYLES[style](df, max_source, max_target, tokenizer, keep_source=keep, **options)


def predict_rows(
    df: DataFrame,
    scorer_factory: ScorerFactory,
    prompt_type: str | None = "chat_prompt",
    adapters: str | dict[str, str] | None = None,
    adapter_col: str = "adapter_name",
    input_col: str = "input",
    eos: str | None = EOS_MARK,
) -> DataFrame:
    """Every input field plus ``target``. Without ``prompt_type`` the raw input is the prompt."""
    fields = df.columns
    prompt: Column = F.col(input_col) if prompt_type is None else template(prompt_type)(F.col(input_col))
    routed = df if adapters is None else route(df, adapters, adapter_col)
    out = predict(routed, scorer_factory, prompt, adapter=None if adapters is None else adapter_col)
    target = clean_answer("out_text", "prompt_text", eos)
    return out.select(*[c for c in fields if c != "target"], target.alias("target"))


def predict_file(spark: SparkSession, path_in: str, path_out: str, scorer_factory: ScorerFactory, schema=None, **options) -> None:
    """JSON lines in, JSON lines out, read and written in parallel."""
    write_jsonl(predict_rows(read_jsonl(spark, path_in, schema), scorer_factory, **options), path_out)
