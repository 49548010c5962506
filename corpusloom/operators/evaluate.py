"""Evaluation from result tables: accuracy, loss, perplexity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.sequences import IGNORE_INDEX, argmax, log_softmax_at

Preprocess = Callable[[Column], Column]


def predictions(df: DataFrame, logits: str = "logits", preprocess: Preprocess = argmax) -> DataFrame:
    """Add ``preds``: ``preprocess`` of the logits at every position (default: the largest)."""
    first = df.schema[logits].dataType
    source = F.col(logits)
    if first.typeName() == "struct":
        # Several model outputs: the logits come first.
        source = source[first.fields[0].name]
    return df.withColumn("preds", F.transform(source, preprocess))


def compared(shift: bool = True, ignore: int | None = None, preds: str = "preds", labels: str = "labels") -> Column:
    """Per row: list of ``{p, y}`` to compare. ``shift`` sets each prediction against the next label."""
    p, y = F.col(preds), F.col(labels)
    if shift:
        p = F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
        y = F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0)))
    pairs = F.arrays_zip(p.alias("p"), y.alias("y"))
    return pairs if ignore is None else F.filter(pairs, lambda z: z["y"] != ignore)


def token_accuracy(
    df: DataFrame, shift: bool = True, ignore: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Share of equal positions. The causal rule shifts and counts ignored labels as errors; the
    masked rule is ``shift=False, ignore=-100``. Null if there is nothing to compare."""
    rows = df.select(*by, compared(shift, ignore).alias("z")).select(
        *by,
        F.size("z").cast("bigint").alias("n"),
        F.size(F.filter("z", lambda z: z["p"] == z["y"])).cast("bigint").alias("ok"),
    )
    n, ok = F.sum("n"), F.sum("ok")
    return rows.groupBy(*by).agg(
        ok.alias("correct"), n.alias("total"), (ok / F.nullif(n, F.lit(0))).alias("accuracy")
    )


def _nll_parts(df: DataFrame, logits: str | None, log_probs: str | None, labels: str, ignore: int) -> tuple[Column, Column]:
    """Per row: summed loss and number of tokens, from logits or from log-probabilities."""
    if (logits is None) == (log_probs is None):
        raise ValueError("give either logits or log_probs")
    values = F.col(logits or log_probs)
    kept = F.filter(F.arrays_zip(values.alias("v"), F.col(labels).alias("y")), lambda z: z["y"] != ignore)
    per_token = (lambda z: log_softmax_at(z["v"], z["y"])) if logits else (lambda z: z["v"])
    loss = F.aggregate(kept, F.lit(0.0), lambda acc, z: acc - per_token(z).cast("double"))
    return loss, F.size(kept).cast("bigint")


def token_losses(
    df: DataFrame,
    logits: str | None = "logits",
    log_probs: str | None = None,
    labels: str = "labels",
    ignore: int = IGNORE_INDEX,
) -> DataFrame:
    """Add ``nll`` (summed over the row) and ``tokens``, the input of ``mean_nll`` and ``perplexity``."""
    nll, tokens = _nll_parts(df, logits, log_probs, labels, ignore)
    return df.withColumns({"nll": nll, "tokens": tokens})


def mean_nll(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood over the tokens that count; null without any."""
    nll, tokens = F.sum("nll"), F.sum("tokens")
    return df.groupBy(*by).agg(tokens.alias("tokens"), (nll / F.nullif(tokens, F.lit(0))).alias("eval_loss"))


def perplexity(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``exp`` of the mean loss; infinity where that overflows, null without tokens."""
    return mean_nll(df, by).withColumn("perplexity", F.exp("eval_loss"))


def evaluate(df: DataFrame, metric: Callable[[DataFrame], DataFrame], preprocess: Preprocess | None = argmax) -> DataFrame:
    """Logits preprocessing, then a metric of the user over ``preds`` and ``labels``."""
    return metric(predictions(df, preprocess=preprocess) if preprocess is not None else df)


def batch_metric(
    df: DataFrame, partial: Callable[[pd.DataFrame], dict[str, float]], parts: Sequence[str], finish: Callable[[dict[str, Column]], Column],
    name: str = "value", columns: Sequence[str] = ("preds", "labels"),
) -> DataFrame:
    """A metric in Python: ``partial`` gives sums for one Arrow batch, ``finish`` combines the totals.

    Only sums leave the batches, so no task sees the whole table.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = partial(batch)
            yield pd.DataFrame({p: [float(got[p])] for p in parts})

    schema = ", ".join(f"`{p}` double" for p in parts)
    totals = df.select(*columns).mapInPandas(sums, schema).agg(*[F.sum(p).alias(p) for p in parts])
    return totals.select(finish({p: F.col(p) for p in parts}).alias(name))


def metrics_table(**metrics: DataFrame) -> DataFrame:
    """One-row metric frames side by side as ``(metric, value)`` rows."""
    out = None
    for prefix, df in metrics.items():
        cols = [F.struct(F.lit(f"{prefix}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
        rows = df.select(F.explode(F.array(*cols)).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out
