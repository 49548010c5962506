"""Near-copies by MinHash with sequential Bayesian verification and exact proof of every link.

1. One pass gives every document the digest of its set of word shingles, the size of the set and a
   signature of ``BANDS * ROWS`` MinHash values. Documents of equal sets form one class; what
   follows handles classes.
2. Classes that share a band of the signature are candidates. In a bucket all members are paired
   with its least member only, so pairs grow with the members and not with their square.
3. A pair's signatures are compared in batches. After m of n values agree, the posterior of the
   similarity (uniform prior) bounds it; the pair is dropped when a similarity of the threshold or
   more is less likely than ``MISS``. Survivors are proved on their full sets.
4. Links give components. What step 2 left out are pairs of members that are both not the least
   one. Where members of a bucket are in different components, these pairs are tested too: within
   blocks of bounded size, in the first band the two share, members of the bucket's main component
   only against the others. Survivors tie their classes to clusters, and the pairs of a cluster are
   proved exactly, in blocks again. Nothing emits pairs: blocks give spanning trees.

A pair at exactly the threshold shares no band with a chance of 1 in 1.3 million and is dropped by
the posterior with at most ``MISS`` per batch; more similar pairs are safer.

Defined cases: a text of fewer words than ``n`` has one shingle of all of them; null and blank
texts have none and are components of their own, every document alone; repeated rows are copies;
null doc_ids never become a component's id unless all of it are null; long texts are read in
parts; an empty table gives none. Only the key and the text are read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import text_of
from corpusloom.llm.ngram_join import blocks, components, linked, maybe_among
from corpusloom.llm.shingles import digest, shingle_set, words_of
from corpusloom.session import cut_lineage

BANDS, ROWS, BATCH, MISS = 24, 5, 24, 1e-6
LABEL = 2  # bytes
BLOCK, PAIRS_PER_HUB, STEP, HANDED_BACK = 512, 2_048, 8_192, 500
_RNG = np.random.default_rng(20240517)
MULTIPLIERS = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of every text of an Arrow array."""
    return (shingle_set(words, n) for words in words_of(texts, lower=True))


def signature(grams: np.ndarray) -> bytes:
    """MinHash labels of a set, 16 bits each."""
    small = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), STEP):
        least = np.minimum(least, (small[None, at : at + STEP] * MULTIPLIERS[:, None] + SHIFTS[:, None]).min(1))
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


@lru_cache(8)
def least_matches(threshold: Fraction, miss: float, values: int = BANDS * ROWS, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m): after n values a pair goes on with m matches or more.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and the chance
    of a similarity of at least t is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in [*range(batch, values, batch), values]:
        chance, below, m = Fraction(0), -1, 0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= miss:
                below = m
                break
        out.append((n, below))
    return tuple(out)


def as_labels(column: pd.Series | pa.Array) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(rows), ">u2").reshape(len(rows), -1)


def likely(left: np.ndarray, right: np.ndarray, threshold: Fraction, miss: float) -> np.ndarray:
    """Which pairs of signatures (same rows of both) survive all batches."""
    alive, matches, before = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in least_matches(threshold, miss):
        matches[alive] += (left[alive, before:n] == right[alive, before:n]).sum(1)
        alive, before = alive[matches[alive] >= least], n
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def arrays(lists: pa.Array) -> Iterator[np.ndarray]:
    """The lists of an Arrow array as unsigned numbers, without a copy."""
    flat, cuts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


def exactly(left: Iterator[np.ndarray], right: Iterator[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Whether the Jaccard similarity of two sorted sets is at least the threshold."""
    out = []
    for a, b in zip(left, right):
        out.append(False)
        if min(len(a), len(b)) * threshold.denominator >= max(len(a), len(b)) * threshold.numerator:
            place = np.searchsorted(a, b)
            both = int((a[np.minimum(place, len(a) - 1)] == b).sum())
            out[-1] = both * threshold.denominator >= (len(a) + len(b) - both) * threshold.numerator
    return np.array(out, bool)


def survivors(group: pd.DataFrame, threshold: Fraction, miss: float) -> pd.DataFrame:
    """Spanning trees (a, b) of the pairs of a block that are in different components, meet first in
    this band, and survive the batches. A group has side 0 alone or sides 0 and 1."""
    group = group.sort_values(["side", "key"], ignore_index=True)
    labels, comp = as_labels(group["labels"]), pd.factorize(group["comp"])[0]
    band, cut = int(group["band"].iloc[0]), int((group["side"] == 0).sum())
    one_sided = cut == len(group)
    mark, edges = np.arange(len(group)), []
    for i in range(cut):
        other = np.arange(i + 1, len(group)) if one_sided else np.arange(cut, len(group))
        other = other[(comp[other] != comp[i]) & (mark[other] != mark[i])]
        if band:
            head = labels[i, : band * ROWS].reshape(band, ROWS)
            met = (labels[other, : band * ROWS].reshape(len(other), band, ROWS) == head).all(2).any(1)
            other = other[~met]
        for j in other[likely(np.broadcast_to(labels[i], (len(other), labels.shape[1])), labels[other], threshold, miss)]:
            if mark[j] != mark[i]:
                mark[mark == mark[j]] = mark[i]
                edges.append((i, j))
    key = group["key"].to_numpy()
    return pd.DataFrame({"a": [key[i] for i, _ in edges], "b": [key[j] for _, j in edges]}, columns=["a", "b"], dtype=object)


def by_hub(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """``pairs`` joined with ``hubs`` on the column ``hub``, the rows of a hub with many pairs dealt over copies of it."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PAIRS_PER_HUB).cast("int").alias("__parts"))
    parts = cut_lineage(parts, "dedup-hubs")
    copies = hubs.join(parts, "hub").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    # hubs of many pairs are few: a pair of any other hub has part 0
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("__parts")).cast("int"), F.lit(0))
    dealt = pairs.join(parts.where("__parts > 1"), "hub", "left").withColumn("__part", part).drop("__parts")
    return dealt.join(copies, ["hub", "__part"]).drop("__part")


def open_blocks(members: DataFrame) -> DataFrame:
    """Members of the buckets whose pairs are not all decided, dealt into blocks: (band, node, pair,
    side, key, comp, labels). Those of a bucket's main component meet the others only."""
    bucket = ["band", "node"]
    sizes = members.groupBy(*bucket, "comp").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*bucket).agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"))
    plan = best.select(
        *bucket,
        F.col("main.comp").alias("main"),
        F.col("all"),
        F.ceil(F.col("main.n") / BLOCK).cast("int").alias("main_parts"),
        F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("other_parts"),
    )
    plan = cut_lineage(plan, "dedup-open")
    rows = members.join(plan, bucket)
    fits, is_main = F.col("all") <= BLOCK, F.col("comp") == F.col("main")
    p = F.pmod(F.xxhash64("key", F.lit(3)), F.when(is_main, F.col("main_parts")).otherwise(F.col("other_parts"))).cast("int")
    rows = rows.withColumn("p", p)
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    name = lambda kind, i, j: F.concat_ws(":", F.lit(kind), i, j)
    p = F.col("p")
    of_main = F.transform(up_to("other_parts"), lambda q: F.struct(name("m", p, q).alias("pair"), F.lit(0).alias("side")))
    to_main = F.transform(up_to("main_parts"), lambda q: F.struct(name("m", q, p).alias("pair"), F.lit(1).alias("side")))
    among = F.transform(
        up_to("other_parts"), lambda q: F.struct(name("o", F.least(p, q), F.greatest(p, q)).alias("pair"), (p > q).cast("int").alias("side"))
    )
    alone = F.array(F.struct(F.lit("").alias("pair"), F.lit(0).alias("side")))
    places = F.when(fits, alone).when(is_main, of_main).otherwise(F.concat(to_main, among))
    return rows.select(*bucket, "key", "comp", F.inline(places))


def near_copies(
    docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(85, 100), miss: float = MISS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""
    threshold = Fraction(threshold)
    if not Fraction(4, 5) <= threshold <= 1:
        raise ValueError("the bands are laid out for thresholds from 0.8 to 1")

    @F.arrow_udf("struct<key: binary, n_shingles: bigint, labels: binary>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, sizes, labels = [], [], []
            for grams in sets_of(texts, n):
                keys.append(digest(grams))
                sizes.append(len(grams))
                labels.append(signature(grams) if len(grams) else None)
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())], ["key", "n_shingles", "labels"]
            )

    @F.arrow_udf("struct<key: binary, grams: array<bigint>>")
    def gathered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (batch[at : at + HANDED_BACK] for batch in batches for at in range(0, len(batch), HANDED_BACK)):
            grams = list(sets_of(texts, n))
            keys = [digest(g) for g in grams]
            cuts = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), lists], ["key", "grams"])

    @F.arrow_udf("boolean")
    def passes(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(likely(as_labels(left), as_labels(right), threshold, miss))

    @F.arrow_udf("boolean")
    def proved(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(exactly(arrays(left), arrays(right), threshold))

    rows = cut_lineage(docs.select(F.col(key).alias("doc_id"), measured(text_of(text)).alias("m")).select("doc_id", "m.*"), "dedup-rows")
    classes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("labels").alias("labels"))
    classes = cut_lineage(classes, "dedup-classes")
    width = ROWS * LABEL
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.cast("tinyint").alias("band"), F.substring("labels", b * width + 1, F.lit(width)).alias("node")),
    )
    placed = classes.select("key", F.inline(bands))
    buckets = placed.groupBy("band", "node").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(placed.join(buckets, ["band", "node"]).where("key != hub"), "dedup-members")
    # 3. every member against the least one of its buckets
    pairs = members.select("key", "hub").distinct().join(classes.select("key", "labels"), "key")
    signed = by_hub(pairs, classes.select(F.col("key").alias("hub"), F.col("labels").alias("hub_labels")))
    tested = cut_lineage(signed.where(passes("labels", "hub_labels")).select("key", "hub"), "dedup-tested")

    def sets(wanted: DataFrame) -> DataFrame:
        """(key, grams) of the classes in ``wanted``; only texts of their first documents are moved."""
        wanted = cut_lineage(wanted.join(classes.select("key", "first_id"), "key"), "dedup-wanted")
        at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        texts = docs.select(at(key).alias("at"), text_of(text).alias("text"))
        found = maybe_among(texts, wanted.select(at("first_id").alias("at")), ["at"]).select(gathered("text").alias("m")).select("m.*")
        return cut_lineage(found.join(wanted.select("key"), "key").dropDuplicates(["key"]), "dedup-sets")

    both = tested.select("key").unionByName(tested.select(F.col("hub").alias("key"))).distinct()
    known = sets(both)
    compared = by_hub(tested.join(known, "key"), known.select(F.col("key").alias("hub"), F.col("grams").alias("hub_grams")))
    links = compared.where(proved("grams", "hub_grams")).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    links = cut_lineage(links, "dedup-links")
    # 4. members that are both not the least, where they are in different components
    comps = components(links)
    named = members.join(comps.withColumnRenamed("id", "key"), "key", "left").select("band", "node", "key", F.coalesce("label", "key").alias("comp"))
    mixed_up = named.groupBy("band", "node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").drop("x", "y")
    left_over = cut_lineage(named.join(mixed_up, ["band", "node"]), "dedup-left")
    blocked = open_blocks(left_over).join(classes.select("key", "labels"), "key")
    ties = blocked.groupBy("band", "node", "pair").applyInPandas(lambda group: survivors(group, threshold, miss), "a binary, b binary")
    ties = components(cut_lineage(ties, "dedup-ties"))
    whole = ties.select(F.col("id").alias("key"), F.col("label").alias("cluster"))
    more = sets(whole.select("key")).join(whole, "key").withColumn("n_copies", F.lit(1).cast("bigint"))
    more = cut_lineage(more.withColumn("size", F.size("grams")), "dedup-clusters")
    found = blocks(more).groupBy("cluster", "pair").applyInPandas(
        lambda group: linked(group, float(threshold)), "key binary, links long, hub binary"
    )
    links = links.unionByName(found.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    comps = components(cut_lineage(links, "dedup-links"))
    info = classes.select("key", "first_id").join(comps.withColumnRenamed("id", "key"), "key", "left")
    info = cut_lineage(info.withColumn("label", F.coalesce("label", "key")), "dedup-info")
    least = info.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = cut_lineage(info.join(least, "label").select("key", "component_id"), "dedup-ids")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        rows.drop("labels")
        .join(ids, "key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
