"""Self-join of documents on the Jaccard similarity of their word n-grams.

1. Documents of equal words form one class (key: digest of the words); what follows handles classes.
2. A MinHash LSH forest: each class has ``TREES`` sequences of ``DEPTH`` labels, and the sorted label
   sequences of a tree are a prefix trie. The prefix that must match is shortened from ``DEPTH`` label
   by label until the target recall is reached twice: by two sets of exactly the threshold (more
   similar ones meet more often), and by all pairs of classes that are similar by their whole
   signatures, which also tell how deep they meet. These pairs are looked for in the clusters of a
   prefix so short that it misses a pair at the threshold once in a million at most (``WITNESS``).
   The sequences are sorted by range; a run of equal prefixes is a trie node. Its classes are tied to
   the first of the run in each range, the ends of ranges to each other where a run goes on. Connected
   sets of these ties are the candidate clusters: every pair that shares a prefix lies within one, and
   so do pairs that only a third class brings together.
3. Exact verification of all pairs of a cluster whose sizes allow the threshold. Large clusters are
   dealt by size class and hash into blocks of bounded size, and each pair of blocks is one group.
   A group gives per class the number of documents linked and a spanning tree of its links, never
   the pairs, so a cluster of thousands of near copies costs rows in proportion to its blocks.

Links join documents with a similarity of at least ``threshold`` and copies (equal words). The
class id of a document is the least doc_id among all that links connect it with.

Defined cases: a text of fewer words than ``n`` has one n-gram of all of them; null and blank texts
have none and are copies of each other only; a null doc_id is no class id unless all of a class are
null; repeated rows are copies; an empty table gives none. Columns of the input other than the key
and the text are left alone; clashing names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import text_of, without
from corpusloom.llm.shingles import digest, shingle_set, words_of
from corpusloom.session import cut_lineage

TREES, DEPTH, RECALL = 32, 8, 0.9999
WITNESS = 0.999999  # recall of the prefix whose clusters hold the pairs that longer ones are measured by
LABEL = 2  # bytes
BLOCK_ROWS, BLOCK_GRAMS = 512, 1 << 20
SIZE_STEP = 1.26  # a little over 1 / 0.8: linked sets are in the same or the next size class
PAGE, BITS_EACH, MOST_BITS = 1 << 15, 8, 1 << 27
STEP, HANDED_BACK = 4_096, 500
ADDED = ("class_id", "n_copies", "n_links")
_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def prefix_length(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold is met with the target recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def one_sided(group: pd.DataFrame) -> bool:
    """Whether a group of ``blocks`` holds the pairs inside one block, not those between two."""
    pair = group["pair"].iloc[0].split(":")
    return pair[:2] == pair[2:] or len(pair) == 1


def depths(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """How many pairs of a group, similar by their whole signatures, share at least 0, 1, … ``DEPTH``
    labels in some tree; both classes of a pair count."""
    group = group.sort_values("side", ignore_index=True)
    every = np.frombuffer(b"".join(group["grams"]), np.uint16).reshape(len(group), TREES * DEPTH)
    cut, inside = int((group["side"] == 0).sum()), one_sided(group)
    met = np.zeros(DEPTH + 1, np.int64)
    for i in range(cut):
        same = every[i + 1 if inside else cut :] == every[i]
        same = same[np.count_nonzero(same, axis=1) >= threshold * TREES * DEPTH]
        if len(same):
            deepest = np.logical_and.accumulate(same.reshape(-1, TREES, DEPTH), axis=2).sum(2).max(1)
            met += 2 * (deepest[:, None] >= np.arange(DEPTH + 1)).sum(0)
    return pd.DataFrame({"depth": np.arange(DEPTH + 1), "n": met})


def witnesses(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, labels, cluster) of the classes that share the prefix of recall ``WITNESS`` with another one."""
    clusters = candidates(classes, prefix_length(threshold, WITNESS))
    return cut_lineage(maybe_among(classes.select("key", "labels"), clusters, ["key"]).join(clusters, "key"), "join-witnesses")


def met_by_depth(classes: DataFrame, threshold: float, found: DataFrame | None = None) -> list[int]:
    """How many pairs of a class and any other one, similar by their whole signatures, share at least
    0, 1, … ``DEPTH`` labels in some tree. All pairs inside the clusters of ``found`` (``witnesses``,
    looked for if not given) are compared; only ``DEPTH + 1`` sums come to the driver."""
    found = witnesses(classes, threshold) if found is None else found
    members = found.select("cluster", "key", F.lit(1).alias("n_copies"), F.col("labels").alias("grams"), F.lit(1).alias("size"))
    met = blocks(members).groupBy("cluster", "pair").applyInPandas(lambda group: depths(group, threshold), "depth int, n long")
    sums = {r.depth: r.n for r in met.groupBy("depth").agg(F.sum("n").alias("n")).collect()}
    return [sums.get(k, 0) for k in range(DEPTH + 1)]


def adapted_length(classes: DataFrame, threshold: float, recall: float = RECALL, found: DataFrame | None = None) -> int:
    """The longest prefix with which a pair at the threshold and the similar pairs of all classes are
    both met with the target recall."""
    met = met_by_depth(classes, threshold, found)
    k = prefix_length(threshold, recall)
    while k > 1 and met[k] < recall * met[0]:
        k -= 1
    return k


def labels(grams: np.ndarray) -> bytes:
    """The label sequences of all trees, one after another."""
    small = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), STEP):
        least = np.minimum(least, (small[None, at : at + STEP] * MULTIPLIERS[:, None] + SHIFTS[:, None]).min(1))
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(">u2").tobytes()


def text_hash(text: Column) -> Column:
    return F.xxhash64(text_of(text))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id that edges (a, b) connect each id with.

    Each round hangs every vertex on its least neighbour, follows these pointers to their ends by
    doubling, and goes on with the edges between the ends. All rounds are tables.
    """
    both = lambda e: e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "graph-edges")
    whole = None
    while True:
        least = both(edges).groupBy("id").agg(F.min("to").alias("to"))
        tree = cut_lineage(least.select("id", F.least("id", "to").alias("label")), "graph-tree")
        if tree.isEmpty():
            return whole if whole is not None else tree
        while True:
            up = tree.select(F.col("id").alias("label"), F.col("label").alias("up"))
            moved = cut_lineage(tree.join(up, "label").select("id", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), "graph-tree")
            tree = moved.select("id", "label")
            if moved.where("moved").isEmpty():
                break
        if whole is None:
            whole = tree
        else:
            next_label = tree.select(F.col("id").alias("label"), F.col("label").alias("next"))
            whole = cut_lineage(whole.join(next_label, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "graph-labels")
        ends = tree.select(F.col("id"), F.col("label"))
        edges = edges.join(ends.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(
            ends.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b"
        )
        edges = cut_lineage(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b").distinct(), "graph-edges")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of both lists."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), STEP):
        lo, hi = np.searchsorted(place, [at, at + STEP])
        part = np.zeros((len(sets), min(STEP, int(often.sum()) - at)), np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def linked(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside a group (all on side 0) or between its sides 0 and 1: per class the documents
    linked to it, and one class of its connected set."""
    group = group.sort_values(["side", "key"], ignore_index=True)
    sets = [np.asarray(g).view(np.uint64) for g in group["grams"]]
    sizes, copies = np.array([len(s) for s in sets]), group["n_copies"].to_numpy()
    inside = one_sided(group)
    cut = int((group["side"] == 0).sum())
    rows, cols = np.arange(cut), np.arange(len(sets)) if inside else np.arange(cut, len(sets))
    both = shared([sets[i] for i in rows], [sets[i] for i in cols])
    union = sizes[rows][:, None] + sizes[cols][None, :] - both
    near = both >= threshold * union - 1e-9 * union
    if inside:
        np.fill_diagonal(near, False)
        every = near
    else:
        every = np.zeros((len(sets), len(sets)), bool)
        every[:cut, cut:], every[cut:, :cut] = near, near.T
    links, mark = every @ copies, np.arange(len(sets))
    for start in range(len(sets)):
        if mark[start] == start and every[start].any():
            front = np.array([start])
            while len(front):
                found = np.flatnonzero(every[front].any(0))
                front = found[mark[found] > start]
                mark[front] = start
    hit = np.flatnonzero(links > 0)
    return pd.DataFrame({"key": group["key"].to_numpy()[hit], "links": links[hit], "hub": group["key"].to_numpy()[mark[hit]]})


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) of a sorted range of (tree, node, key): each key with the first one of its node, and
    the ends of the range as (a, none, tree, node)."""
    names = ["a", "b", "tree", "node"]

    def end(row: tuple) -> pa.RecordBatch:
        tree, node, key = row
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([None], pa.binary()), pa.array([tree], pa.int8()), pa.array([node], pa.binary())], names
        )

    hub = last = None
    for batch in (b for b in batches if b.num_rows):
        trees, nodes, keys = (batch.column(i) for i in range(3))
        first = (trees[0].as_py(), nodes[0].as_py(), keys[0].as_py())
        goes_on = last is not None and last[:2] == first[:2]
        if last is None:
            yield end(first)
        number = trees.to_numpy()
        path = np.frombuffer(b"".join(nodes.to_pylist()), np.uint8).reshape(len(number), -1)
        begins = np.ones(len(number), bool)
        begins[1:] = (number[1:] != number[:-1]) | (path[1:] != path[:-1]).any(1)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(number)), 0))
        # place 0 is the first key of the node that the batch before ended in
        firsts = pa.concat_arrays([pa.array([hub if goes_on else first[2]], pa.binary()), keys])
        at = np.where((at == 0) & goes_on, 0, at + 1)
        tied = pa.array(~begins | ((np.arange(len(number)) == 0) & goes_on))
        a, b = keys.filter(tied), firsts.take(pa.array(at)).filter(tied)
        yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int8()), pa.nulls(len(a), pa.binary())], names)
        hub = firsts[int(at[-1])].as_py()
        last = (trees[-1].as_py(), nodes[-1].as_py(), keys[-1].as_py())
    if last is not None:
        yield end(last)


def candidates(classes: DataFrame, prefix: int) -> DataFrame:
    """(key, cluster) of the classes that share a prefix of some tree with another one."""
    width = DEPTH * LABEL
    rows = classes.where(F.col("labels").isNotNull()).select(
        F.inline(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(
                    t.cast("tinyint").alias("tree"), F.substring("labels", t * width + 1, F.lit(prefix * LABEL)).alias("node"), F.col("key").alias("key")
                ),
            )
        ),
    )
    # Equal prefixes are split among ranges by their keys, so a node of any size is spread.
    tries = rows.repartitionByRange("tree", "node", "key").sortWithinPartitions("tree", "node", "key")
    ties = cut_lineage(tries.mapInArrow(runs, "a binary, b binary, tree tinyint, node binary"), "join-ties")
    ends = ties.where(F.col("b").isNull()).select("a", "tree", "node")
    hubs = ends.groupBy("tree", "node").agg(F.min("a").alias("b"))
    ties = ties.where(F.col("b").isNotNull()).select("a", "b").unionByName(ends.join(hubs, ["tree", "node"]).select("a", "b"))
    return components(ties).withColumnRenamed("label", "cluster").withColumnRenamed("id", "key")


def blocks(members: DataFrame) -> DataFrame:
    """Members of clusters dealt into groups: (group, side, key, n_copies, grams), each of bounded size."""
    tier = F.floor(F.log(F.col("size")) / F.log(F.lit(SIZE_STEP))).cast("int")
    members = members.withColumn("tier", tier)
    per_tier = cut_lineage(
        members.groupBy("cluster", "tier").agg(F.count("*").alias("n"), F.sum("size").alias("grams_n")), "join-tiers"
    )
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("grams_n") / BLOCK_GRAMS)).cast("int")
    own = per_tier.select("cluster", "tier", parts.alias("parts"))
    whole = per_tier.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("grams_n").alias("grams_n"))
    small = whole.select("cluster", ((F.col("n") <= BLOCK_ROWS) & (F.col("grams_n") <= BLOCK_GRAMS)).alias("fits"))
    beside = lambda step, name: own.select("cluster", (F.col("tier") - step).alias("tier"), F.col("parts").alias(name))
    plan = (
        own.join(beside(1, "above"), ["cluster", "tier"], "left").join(beside(-1, "below"), ["cluster", "tier"], "left").join(small, "cluster")
    )
    plan = cut_lineage(plan, "join-plan")
    dealt = members.join(plan, ["cluster", "tier"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int"))
    name = lambda t, p, u, q: F.concat_ws(":", t, p, u, q)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    t, p = F.col("tier"), F.col("part")
    same = F.transform(
        up_to(F.col("parts")),
        lambda q: F.struct(name(t, F.least(p, q), t, F.greatest(p, q)).alias("pair"), (p > q).cast("int").alias("side")),
    )
    above = F.transform(up_to(F.coalesce("above", F.lit(0))), lambda q: F.struct(name(t, p, t + 1, q).alias("pair"), F.lit(0).alias("side")))
    below = F.transform(up_to(F.coalesce("below", F.lit(0))), lambda q: F.struct(name(t - 1, q, t, p).alias("pair"), F.lit(1).alias("side")))
    every = F.when(F.col("fits"), F.array(F.struct(F.lit("").alias("pair"), F.lit(0).alias("side")))).otherwise(F.concat(same, above, below))
    return dealt.select("cluster", "key", "n_copies", "grams", F.inline(every))


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that may have a partner in ``wanted`` by ``keys``, told by a bitmap of hashes.

    The bitmap has about ``BITS_EACH`` bits for each wanted row and at most ``MOST_BITS`` (16 MB), so
    it can be broadcast whatever the input; the join that follows is exact. It keeps the texts of
    all other documents out of the shuffle.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(PAGE.bit_length() - 1, (BITS_EACH * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    pages = (
        wanted.select((place / PAGE).cast("int").alias("__page"), (place % PAGE).alias("__bit"))
        .groupBy("__page")
        .agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )
    placed = rows.withColumns({"__page": (place / PAGE).cast("int"), "__bit": (place % PAGE).cast("int")})
    byte = F.conv(F.hex(F.substring("__bitmap", F.expr("__bit div 8").cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(pages), "__page").withColumn("__byte", byte).where(F.expr("shiftright(__byte, __bit % 8) & 1 = 1"))
    return found.select(*rows.columns)


def jaccard_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, key, class_id, n_copies, n_links, text_hash, rep): one row per document.

    ``n_copies`` counts the documents of equal words, itself included; ``n_links`` the other
    documents it is linked with, copies included; ``rep`` tells whether its text and id are those
    kept for its class.
    """
    if not 1 / SIZE_STEP < threshold <= 1:
        raise ValueError(f"the threshold must be over {1 / SIZE_STEP:.2f} and at most 1")

    @F.arrow_udf("struct<key: binary, labels: binary>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, found = [], []
            for words in words_of(texts, lower=False):
                grams = shingle_set(words, n)
                keys.append(digest(words))
                found.append(labels(grams) if len(grams) else None)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "labels"])

    @F.arrow_udf("array<bigint>")
    def shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (batch[at : at + HANDED_BACK] for batch in batches for at in range(0, len(batch), HANDED_BACK)):
            grams = [shingle_set(words, n) for words in words_of(texts, lower=False)]
            cuts = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))

    rows = docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), measured(text_of(text)).alias("m"))
    rows = cut_lineage(rows.select("doc_id", "text_hash", "m.*"), "join-rows")
    classes = rows.groupBy("key").agg(
        # one text stands for the class: that of the least id
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"),
        F.count("*").alias("n_copies"),
        F.max("labels").alias("labels"),
    )
    classes = classes.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash"), "n_copies", "labels")
    classes = cut_lineage(classes, "join-classes")
    # What shares the longer prefix shares the shorter one too, so only these classes are sorted again.
    near = witnesses(classes, threshold)
    clusters = candidates(near, adapted_length(classes, threshold, found=near))
    no_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wanted = classes.join(clusters, "key").select("key", "cluster", "n_copies", "text_hash", no_id("first_id").alias("at"))
    wanted = cut_lineage(wanted, "join-wanted")
    # Only the text that stands for a class is moved; copies spread over tasks by their own ids.
    found = docs.select(no_id(key).alias("at"), text_hash(F.col(text)).alias("text_hash"), text_of(text).alias("text"))
    texts = maybe_among(found, wanted, ["at", "text_hash"]).join(wanted, ["at", "text_hash"])
    members = texts.dropDuplicates(["key"]).select("key", "cluster", "n_copies", shingled("text").alias("grams"))
    members = cut_lineage(members.withColumn("size", F.size("grams")), "join-members")
    found = blocks(members).groupBy("cluster", "pair").applyInPandas(
        lambda group: linked(group, threshold), "key binary, links long, hub binary"
    )
    found = cut_lineage(found, "join-links")
    joined = components(found.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = classes.select("key", "first_id", "text_hash", "n_copies").join(counts, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left")
    info = cut_lineage(info.withColumn("label", F.coalesce("label", "key")), "join-info")
    least = info.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key", "text_hash")).alias("m"))
    info = info.join(least, "label").select(
        "key", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("m.first_id").alias("class_id"), F.col("m.key").alias("rep_key"), F.col("m.text_hash").alias("rep_text")
    )
    return rows.drop("labels").join(info, "key").select(
        "doc_id",
        "key",
        "class_id",
        "n_copies",
        (F.col("n_copies") - 1 + F.col("links")).alias("n_links"),
        "text_hash",
        ((F.col("key") == F.col("rep_key")) & (F.col("text_hash") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("rep"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: the one of the least id."""
    kept = jaccard_classes(docs, n, threshold, text, key).where("rep")
    kept = cut_lineage(kept.select("doc_id", "text_hash").distinct(), "join-kept")
    names = {"__at": F.coalesce(F.col(key).cast("string"), F.lit("")), "__text": text_hash(F.col(text))}
    wanted = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__at"), F.col("text_hash").alias("__text"))
    out = without(docs, *names).withColumns(names).join(wanted, list(names), "left_semi")
    return out.dropDuplicates(list(names)).drop(*names)
