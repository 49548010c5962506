"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics. Per class Spark sums counts,
vectors and their products over all labelled training documents; these sums are all the driver
sees. Each class covariance is shrunk towards the pooled one and towards a multiple of the
identity, its Cholesky factor is computed once, and the score of a document is the logistic of the
difference of log densities (Mahalanobis distance and determinant) and log class shares.

Defined cases: null text is an empty one and gets a score like any other; documents without a
label or with another than 0 and 1 do not train; a class with no training documents leaves the
class shares as the score, and no training documents at all give 0.5; repeated rows count each.
Extra columns stay; those that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import text_of, without

STATISTICS = (
    "log_chars", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "others",
    "distinct", "repeats", "short_words", "line_words", "dup_lines", "stops",
)
TO_POOLED, TO_IDENTITY = 0.1, 0.02
TEMPERATURE = 4.0
ADDED = ("score", "predicted")
THRESHOLD = 0.3
_CLASS = np.zeros(128, np.int64)
for _names, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), ("!?,;:'\"()-", 3), ("#*$%&|<>@~^_=+/\\{}[]`", 4), (".", 5), (" \t\n\r\x0b\x0c", 6)):
    for _c in _names:
        _CLASS[ord(_c)] = _k


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(codes)
    kinds = np.bincount(_CLASS[codes[codes < 128]], minlength=7) if n else np.zeros(7)
    words = text.split()
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    count, lines = max(1, len(words)), [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    solid = max(1, n - kinds[6])
    share = lambda k, of: np.log((k + 0.1) / (of + 1.0))
    return np.array(
        [
            np.log1p(n),
            np.log1p(sizes.mean()),
            np.log1p(sizes.std()),
            share(kinds[1], solid),
            share(kinds[2], solid),
            share(kinds[3], count),
            share(kinds[4], count),
            np.log1p((codes >= 128).sum() / solid),
            np.log(len(set(words)) + 1) / np.log(count + 1.0),
            share(same, count),
            share((sizes <= 3).sum(), count),
            np.log1p(count / max(1, len(lines))),
            share(len(lines) - len(set(lines)), max(1, len(lines))),
            share(kinds[5], count),
        ]
    )


@dataclass
class Discriminant:
    """Per class: count, mean and Cholesky factor of the shrunk covariance."""

    counts: list[float]
    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        prior = np.log(self.counts[1] + 1.0) - np.log(self.counts[0] + 1.0)
        if not self.factors:
            return np.full(len(x), 1 / (1 + np.exp(-prior)))
        z = (x - self.center) / self.scale
        logs = []
        for mean, factor in zip(self.means, self.factors):
            away = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (away**2).sum(0) - np.log(np.diag(factor)).sum())
        gap = np.clip((logs[1] - logs[0] + prior) / TEMPERATURE, -500, 500)
        return 1 / (1 + np.exp(-gap))


def from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The discriminant of (count, sum of vectors, sum of products) of classes 0 and 1."""
    d = len(STATISTICS)
    counts = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
    if min(counts) < 1:
        return Discriminant(counts, np.zeros(d), np.ones(d))
    total = sum(counts)
    center = sum(sums[c][1] for c in (0, 1)) / total
    scale = np.sqrt(np.maximum(np.diag(sum(sums[c][2] for c in (0, 1))) / total - center**2, 1e-6))
    means, covs = [], []
    for c in (0, 1):
        mean = sums[c][1] / counts[c]
        means.append((mean - center) / scale)
        covs.append((sums[c][2] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(n * cov for n, cov in zip(counts, covs)) / total
    model = Discriminant(counts, center, scale, means)
    for cov in covs:
        shrunk = (1 - TO_POOLED) * cov + TO_POOLED * pooled
        shrunk = (1 - TO_IDENTITY) * shrunk + TO_IDENTITY * max(np.trace(shrunk) / d, 1e-3) * np.eye(d)
        model.factors.append(np.linalg.cholesky(shrunk))
    return model


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``statistics`` (array<double>)."""

    @F.pandas_udf("array<double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch])

    return without(docs, "statistics").withColumn("statistics", told(text_of(text)))


def fit(labelled: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on rows with ``statistics`` and a label of 0 or 1: one row of sums per class and task."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for c in (0, 1):
                rows = batch.loc[batch["label"] == c, "statistics"]
                if len(rows):
                    x = np.stack(rows.to_numpy())
                    n, s, p = sums.get(c, (0, 0.0, 0.0))
                    sums[c] = (n + len(x), s + x.sum(0), p + x.T @ x)
        for c, (n, s, p) in sums.items():
            values = np.concatenate([[n], s, p.ravel()])
            yield pd.DataFrame({"label": c, "place": np.arange(len(values)), "value": values})

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), "statistics")
    summed = rows.mapInPandas(partial, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = {}
    for c, part in summed.toPandas().groupby("label"):
        v = part.sort_values("place")["value"].to_numpy()
        sums[int(c)] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return from_sums(sums)


def predict(measured: DataFrame, model: Discriminant) -> DataFrame:
    """Add ``score`` and ``predicted`` to rows with ``statistics``."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(np.stack(batch.to_numpy())) if len(batch) else [], dtype="float64")

    out = without(measured, *ADDED).withColumn("score", scored("statistics"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
