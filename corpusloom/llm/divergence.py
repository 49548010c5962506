"""Audit of how the sources of a language differ in the words they use, in exact arithmetic.

1. Terms are counted per (language, source) inside the tasks. A task hands back one row per language
   and term with a list of sources and counts, so the terms that too few documents of the language
   hold go before the lists are opened and summed.
2. A group's count of a term is its level. One-hot indicator columns for (group, level) make a
   matrix of terms by columns, and its product with its transpose holds, for every two groups and
   every two levels, the number of terms that have these levels: the joint tables. The product is
   formed in blocks (hashed terms by blocks of groups); entries are whole numbers below 2**24, so
   single-precision products are exact. Terms that neither group has are not in the blocks and are
   added as the rest of the vocabulary.
3. Prices depend on the two levels only, so a distance is a sum over the joint table.

Defined cases: a null text, language or source counts as ''; a text without terms counts for
nothing, but its group is audited; a language without kept terms has distances of 0 and no term
rows; ties are ranked by item in UTF-8 order; repeated rows are documents of their own; texts are
read in parts, however long; an empty table gives no rows. Columns other than the three are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import text_of
from corpusloom.session import cut_lineage

TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")  # of lower-cased UTF-8
PART, HELD_TERMS = 1 << 20, 1_000_000
BLOCK_TERMS, BLOCK_GROUPS, TILE = 2_048, 32, 1_024
UNIT, MIN_DOCS, TOP_TERMS = 1_000_000_000, 10, 10


def text_parts(body: bytes, part: int = PART) -> Iterator[bytes]:
    """A text in parts of about ``part`` bytes, cut between terms."""
    at = 0
    while at < len(body):
        end = BREAK.search(body, at + part) if at + part < len(body) else None
        end = end.start() if end else len(body)
        yield body[at:end]
        at = end


Counts = dict[tuple[str, str], tuple[Counter, Counter]]


def held_terms(counts: Counts) -> pa.RecordBatch:
    """What a task has counted, as one row per language and term with a list of its sources."""
    langs, sources = (pa.array([g[i] for g in counts], pa.string()) for i in (0, 1))
    group = np.repeat(np.arange(len(counts)), [len(total) for total, _ in counts.values()])
    found = pa.array([t for total, _ in counts.values() for t in total], pa.binary()).dictionary_encode()
    n = np.fromiter((n for total, _ in counts.values() for n in total.values()), np.int64, len(group))
    docs = np.fromiter((docs[t] for total, docs in counts.values() for t in total), np.int64, len(group))
    lang = np.unique(langs.to_numpy(zero_copy_only=False), return_inverse=True)[1][group]
    term = found.indices.to_numpy()
    order = np.argsort(lang * np.int64(len(found.dictionary) + 1) + term, kind="stable")
    lang, term, group, n, docs = (x[order] for x in (lang, term, group, n, docs))
    at = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])]) if len(order) else np.zeros(0, np.int64)
    cuts = pa.array(np.r_[at, len(order)].astype(np.int32))
    columns = {
        "lang": langs.take(pa.array(group[at])),
        "term": found.dictionary.take(pa.array(term[at])).cast(pa.string()),
        "n": pa.array(np.add.reduceat(n, at) if len(at) else n),
        "docs": pa.array(np.add.reduceat(docs, at) if len(at) else docs),
        "sources": pa.ListArray.from_arrays(cuts, sources.take(pa.array(group))),
        "counts": pa.ListArray.from_arrays(cuts, pa.array(n)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the rows of a task, summed as far as memory allows."""
    counts: Counts = {}
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            total, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in text_parts(text.encode().lower()):
                terms = TERM.findall(part)
                total.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(total) for total, _ in counts.values()) > HELD_TERMS:
            yield held_terms(counts)
            counts = {}
    if counts:
        yield held_terms(counts)


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first) of the terms that ``min_docs`` documents of a language hold.

    ``total`` is the count in the language, ``first`` true for one source of each term.
    """
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    schema = "lang string, term string, n bigint, docs bigint, sources array<string>, counts array<bigint>"
    # Tasks have summed their own rows; one shuffle serves the windows over a term and the sums.
    counted = rows.mapInArrow(count_terms, schema).repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    whole = counted.withColumns(
        {"in_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "least": F.min(F.array_min("sources")).over(of_term)}
    )
    opened = whole.where(F.col("in_docs") >= min_docs).select(
        "lang", "term", "total", "least", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))
    )
    summed = opened.groupBy("lang", "term", "source", "total", "least").agg(F.sum("n").alias("n"))
    return summed.select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).alias("first"))


def level_products(block: pd.DataFrame, block_groups: int = BLOCK_GROUPS, tile_columns: int = TILE) -> pd.DataFrame:
    """Joint tables of one block: rows (g, a, h, b, n), g < h, of the product of its indicator matrix."""
    term = np.unique(block["term"].to_numpy(), return_inverse=True)[1]
    group, level = block["g"].to_numpy(), block["n"].to_numpy()
    n_terms = int(term.max()) + 1
    left, right = (block["left"].iloc[0], block["right"].iloc[0])
    columns = {}  # group block -> (group and level of each column, its terms, its columns)
    for side in {left, right}:
        mine = group // block_groups == side
        # Every group has a level for every term of the block: 0 where there is no row.
        groups = np.arange(side * block_groups, min((side + 1) * block_groups, int(block["last"].iloc[0]) + 1))
        table = np.zeros((len(groups), n_terms), np.int64)
        table[group[mine] - groups[0], term[mine]] = level[mine]
        pairs, place = np.unique(np.stack([np.repeat(groups, n_terms), table.ravel()]), axis=1, return_inverse=True)
        columns[side] = pairs, np.tile(np.arange(n_terms), len(groups)), place.ravel()

    def tile(side: int, at: int) -> np.ndarray:
        pairs, rows, place = columns[side]
        inside = (place >= at) & (place < at + tile_columns)
        hot = np.zeros((n_terms, min(tile_columns, pairs.shape[1] - at)), np.float32)
        hot[rows[inside], place[inside] - at] = 1
        return hot

    out = []
    for i in range(0, columns[left][0].shape[1], tile_columns):
        x = tile(left, i)
        for j in range(i if left == right else 0, columns[right][0].shape[1], tile_columns):
            product = x.T @ (x if left == right and i == j else tile(right, j))
            p, q = np.nonzero(product)
            (g, a), (h, b) = columns[left][0][:, i + p], columns[right][0][:, j + q]
            out.append(np.stack([g, a, h, b, product[p, q].astype(np.int64)])[:, g < h])
    g, a, h, b, n = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    return pd.DataFrame({"lang": block["lang"].iloc[0], "g": g, "a": a, "h": h, "b": b, "n": n})


def joint_parts(
    counts: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS, tile: int = TILE
) -> DataFrame:
    """(lang, g, a, h, b, n): how many terms of a block two groups of a language have at levels a and b.

    ``counts`` is (lang, g, term, n), ``groups`` (lang, g, terms, last) with the size of the
    vocabulary and the largest group number. The joint table of two groups is the sum of its blocks;
    its entry of two zeros lacks the terms that no group of the two blocks has.
    """
    rows = counts.join(groups.select("lang", "g", "terms", "last"), ["lang", "g"])
    blocks = F.ceil(F.col("terms") / block_terms).cast("int")
    mine, last = F.expr(f"int(g div {block_groups})"), F.expr(f"int(last div {block_groups})")
    sides = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(mine, k).alias("left"), F.greatest(mine, k).alias("right")))
    rows = rows.select("lang", "g", "last", "term", "n", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), F.inline(sides))
    return rows.groupBy("lang", "block", "left", "right").applyInPandas(
        lambda block: level_products(block, block_groups, tile), "lang string, g bigint, a bigint, h bigint, b bigint, n bigint"
    )


def share(count: Column, total: Column, terms: Column, unit: int = UNIT) -> Column:
    """1 + floor(unit * (count + 2) / (total + 2 * terms)), in whole numbers; decimals where a long is too short."""
    wide = lambda c: c.cast("decimal(18,0)")
    below = F.nullif(total + terms * 2, F.lit(0))
    exact = F.call_function("div", (wide(count) + 2) * F.lit(unit).cast("decimal(10,0)"), wide(below))
    return F.when(count < (1 << 62) // unit, F.call_function("div", (count + 2) * unit, below)).otherwise(exact) + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    blocks: tuple[int, int, int] = (BLOCK_TERMS, BLOCK_GROUPS, TILE),
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` ranks the other sources of the language by distance, part ``term`` the ``top``
    terms that the source uses more than its language does. ``blocks`` sizes the matrix products:
    terms and groups of a block, columns of a tile.
    """
    kept = cut_lineage(kept_terms(docs, text, lang, source, min_docs), "audit-kept")
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("in_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = (
        docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"))
        .distinct()
        .join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["in_group", "terms", "in_lang"])
        .withColumn("g", F.row_number().over(by_source).cast("bigint") - 1)
        .withColumn("last", F.count("*").over(Window.partitionBy("lang")) - 1)
    )
    groups = cut_lineage(groups, "audit-groups")
    numbered = kept.join(groups.select("lang", "source", "g"), ["lang", "source"]).select("lang", "g", "term", "n")
    # A price is linear in the entries, so the blocks are priced as they come and only sums are moved.
    tables = joint_parts(numbered, groups, *blocks)
    side = lambda g, name, p: groups.select("lang", F.col("g").alias(g), F.col("in_group").alias(name), *p)
    priced = tables.join(side("g", "in_g", ["terms"]), ["lang", "g"]).join(side("h", "in_h", []), ["lang", "h"])
    f = price(share(F.col("a"), F.col("in_g"), F.col("terms")), share(F.col("b"), F.col("in_h"), F.col("terms")))
    # at most ``UNIT`` for every term of the vocabulary: a long holds it
    distance = priced.groupBy("lang", "g", "h").agg(F.sum(F.col("n") * f).alias("found"), F.sum("n").alias("n"))
    one = groups.select("lang", "terms", F.col("g"), F.col("source").alias("one"), F.col("in_group").alias("in_g"))
    other = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("other"), F.col("in_group").alias("in_h"))
    pairs = one.join(other, "lang").where("g < h").join(distance, ["lang", "g", "h"], "left")
    nothing = price(share(F.lit(0), F.col("in_g"), F.col("terms")), share(F.lit(0), F.col("in_h"), F.col("terms")))
    rest = (F.col("terms") - F.coalesce("n", F.lit(0))) * F.coalesce(nothing, F.lit(0))
    value = F.coalesce("found", F.lit(0)) + rest
    pairs = pairs.select("lang", "one", "other", value.alias("value"))
    both = pairs.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "value")
    )
    p, q = share(F.col("n"), F.col("in_group"), F.col("terms")), share(F.col("total"), F.col("in_lang"), F.col("terms"))
    terms = kept.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    as_part = lambda df, part: df.withColumn("rank", ranked).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return as_part(both, "pair").unionByName(as_part(terms, "term").where(F.col("rank") <= top))
