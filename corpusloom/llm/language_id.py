"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed character n-grams
tells the languages whose bit is set from the others: its weights are log ratios of the mean
n-gram shares of both sides, from counts that Spark sums over all training documents. A text's
bit scores are decoded by the logistic loss against each codeword, bits weighted by how far apart
their two sides are; the codeword of least loss wins, and a text whose two best codewords are
close is flagged as ambiguous.

Defined cases: a text without a letter, empty or null, is ``und`` with score 0; documents without
a language do not train; with no training document every text is ``und``; one language alone
always wins. Repeated rows train as often as they occur; equal losses go to the lesser language.
Extra columns stay; those that clash with the added ones are replaced. Texts are used whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import text_of, without

BUCKETS = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
SHARPNESS = 40.0  # n-grams after which more text makes a bit no surer
AMBIGUOUS = 0.05
UNKNOWN = "und"
MAX_LANGUAGES = 1_000  # counts of one task are languages x BUCKETS numbers
ADDED = ("lang_pred", "score", "ambiguous")
LETTER = regex.compile(r"\p{L}")
OTHERS = regex.compile(r"[^\p{L}]+")
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
STEP = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of a text, in steps of bounded size. Case and everything
    but letters are left out; a blank stands at both ends of a word."""
    plain = f" {OTHERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    longest = max(ORDERS)
    for at in range(0, len(codes), STEP):
        part = codes[at : at + STEP + longest - 1]
        for n in ORDERS:
            size = min(STEP, len(part) - n + 1)
            if size > 0:
                mixed = np.full(size, n, np.uint32)
                for i in range(n):
                    mixed = (mixed ^ part[i : i + size]) * PRIMES[i]
                    mixed ^= mixed >> np.uint32(15)
                yield mixed % np.uint32(BUCKETS)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """languages x bits of -1 and 1: all divisions into two sides where they are few, otherwise the
    seeded random code of the greatest least distance, of 8 bits per doubling."""
    if languages < 2:
        return np.ones((languages, 0), np.float32)
    if languages <= 6:
        sides = [s for s in itertools.product((1, -1), repeat=languages - 1) if -1 in s]
        return np.array([(1, *s) for s in sides], np.float32).T
    bits, rng = 8 * int(np.ceil(np.log2(languages))), np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(32):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        code[:, np.abs(code.sum(0)) == languages] *= rng.choice(np.array([-1, 1]), languages)[:, None]
        apart = bits - (code @ code.T)
        np.fill_diagonal(apart, bits)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # one per bit, mean 1

    def losses(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for found in grams(text):
            total += self.weights[found].sum(0, dtype=np.float64)
            n += len(found)
        margin = total / n * min(n, SHARPNESS) if n else total
        return (self.trust * np.logaddexp(0, -self.code * margin)).sum(1) / max(1, len(self.trust))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        loss = self.losses(text)
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        best = int(loss.argmin())
        second = np.partition(chance, -2)[-2] if len(chance) > 1 else 0.0
        return self.languages[best], float(chance[best]), bool(chance[best] - second < AMBIGUOUS)


def fit(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang") -> Model:
    """Train on all documents for which ``trains`` holds and whose language is not null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"]):
                for found in grams(t):
                    if name not in sums:
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    sums[name] += np.bincount(found, minlength=BUCKETS)
        for name, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": name, "bucket": seen, "n": counts[seen]})

    rows = docs.where(trains & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    summed = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language, BUCKETS numbers at most in each.
    listed = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    found = sorted(listed.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = np.zeros((len(found), BUCKETS))
    for i, row in enumerate(found):
        places, numbers = np.array([(c.bucket, c.n) for c in row.counts], np.int64).T
        shares[i, places] = numbers
    shares = (shares + SMOOTHING) / (shares + SMOOTHING).sum(1, keepdims=True)
    code = codewords(len(found))
    weights, trust = np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = shares[code[:, b] > 0].mean(0), shares[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(yes) - np.log(no)
        trust[b] = ((yes - no) * weights[:, b]).sum()
    if len(trust):
        trust = np.maximum(trust, 1e-9) / np.maximum(trust, 1e-9).mean()
    return Model([r.lang for r in found], code, weights.astype(np.float32), trust)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=list(ADDED))

    # Not moved or repeated by the optimiser: a filter on the result would else run it twice.
    out = without(docs, *ADDED, "__told").withColumn("__told", told.asNondeterministic()(text_of(text)))
    return out.select("*", *[F.col(f"__told.{c}").alias(c) for c in ADDED]).drop("__told")
