"""Batch prediction: routing, scoring with a model of the user, cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip
from corpusloom.operators.instruct import sft_bos
from corpusloom.operators.order import take_head
from corpusloom.session import cut_lineage

# Markers cut from generated text.
END_MARK = "\nEND"
EOS_MARK = "</s>"
BROADCAST_ADAPTERS = 10_000

Scorer = Callable[[list[str]], list[str]]
ScorerFactory = Callable[[str | None, str | None], Scorer]


def parse_adapters(spec: str) -> dict[str, str]:
    """``name,path,name,path``: blanks trimmed, empty parts dropped, the last path of a name wins."""
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if len(parts) % 2:
        raise ValueError("adapter list must hold names and paths in turn")
    return dict(zip(parts[::2], parts[1::2]))


def route(df: DataFrame, adapters: str | dict[str, str], col: str = "adapter_name", out: str = "adapter_path") -> DataFrame:
    """Add the path of the adapter named in each row; a missing or unknown name fails the job.

    A list of at most ``BROADCAST_ADAPTERS`` is broadcast; Spark plans the join with a longer one.
    """
    if isinstance(adapters, str):
        adapters = parse_adapters(adapters)
    if col not in df.columns:
        raise ValueError(f"no column {col!r} to route by")
    table = df.sparkSession.createDataFrame(list(adapters.items()), f"`{col}` string, `{out}` string")
    routed = df.join(F.broadcast(table) if len(adapters) <= BROADCAST_ADAPTERS else table, col, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown adapter: "), F.coalesce(F.col(col), F.lit("null"))))
    return routed.withColumn(out, F.coalesce(F.col(out), unknown.cast("string")))


def _spread(df: DataFrame, adapter: str, partitions: int) -> DataFrame:
    """Partition by adapter and slot; an adapter has one slot per equal share of the rows."""
    sizes = cut_lineage(df.groupBy(F.col(adapter).alias("__who")).agg(F.count("*").alias("__n")), "adapters")
    share = max(1, -(-(sizes.agg(F.sum("__n")).first()[0] or 0) // partitions))
    slots = sizes.select("__who", F.ceil(F.col("__n") / share).cast("int").alias("__slots"))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return (
        df.join(slots, df[adapter].eqNullSafe(slots["__who"]))
        .withColumn("__slot", F.pmod(F.xxhash64(*[df[c] for c in plain]), F.col("__slots")))
        .repartition(partitions, adapter, "__slot")
        .sortWithinPartitions(adapter)
        .select(*df.columns)
    )


def predict(
    df: DataFrame,
    scorer_factory: ScorerFactory,
    prompt: Column | str = "input",
    out: str = "out_text",
    adapter: str | None = None,
    path: str = "adapter_path",
    partitions: int | None = None,
    batch_rows: int = 64,
) -> DataFrame:
    """Add ``prompt_text`` and the generated text.

    ``scorer_factory(adapter, path)`` builds a function from prompts to texts, once per task and
    adapter. Rows of an adapter go to as many tasks as their number calls for and are sorted by
    adapter inside the task, so models are loaded rarely and a popular adapter is no hot spot.
    """
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    df = df.withColumn("prompt_text", prompt)
    if adapter is not None:
        df = _spread(df, adapter, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    who = (F.col(adapter), F.col(path)) if adapter is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))

    # Only these three columns go to Python; all others stay as they are.
    @F.pandas_udf(T.StringType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        current: tuple | None = None
        scorer: Scorer | None = None
        for prompts, names, paths in batches:
            names, paths = names.where(names.notna(), None), paths.where(paths.notna(), None)
            texts: list[str] = []
            for _, run in prompts.groupby((names != names.shift()).cumsum(), sort=False):
                named = (names[run.index[0]], paths[run.index[0]])
                if scorer is None or named != current:
                    scorer, current = scorer_factory(*named), named
                asked = run.tolist()
                for i in range(0, len(asked), batch_rows):
                    texts.extend(scorer(asked[i : i + batch_rows]))
            yield pd.Series(texts, index=prompts.index, dtype=object)

    return df.withColumn(out, score.asNondeterministic()("prompt_text", *who))


def clean_answer(out: Column | str, prompt: Column | str, eos: str | None = EOS_MARK, prefix_only: bool = False) -> Column:
    """Generated text without prompt and end mark, stripped, then without one closing ``eos``.

    Every copy of the prompt goes, or with ``prefix_only`` just a leading one.
    """
    out = F.col(out) if isinstance(out, str) else out
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    if prefix_only:
        text = F.when(out.startswith(prompt), F.substring(out, F.length(prompt) + 1, F.length(out))).otherwise(out)
    else:
        text = F.when(prompt == "", out).otherwise(F.replace(out, prompt, F.lit("")))
    text = strip(F.replace(text, F.lit(END_MARK), F.lit("")))
    if eos is None:
        return text
    return F.when(text.endswith(eos), F.substring(text, F.lit(1), F.length(text) - len(eos))).otherwise(text)


def prepare(df: DataFrame, split: str = "test", cap: int | None = None, order_by: str = "row_idx", build=sft_bos, **options) -> DataFrame:
    """Cap a split, then build its rows as for training."""
    if cap is None:
        df = df.where(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"split {split!r} is needed but missing")
    else:
        df = take_head(df, cap, split, order_by)
    return build(df, **options)
