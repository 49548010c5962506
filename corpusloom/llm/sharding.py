"""Sharding by a k-d tree over document metadata.

The tree is cut level by level. Each node takes the dimension in which its rows spread widest and
is split at the weighted median (or the quantile its share of shards calls for). The median is
found by three distributed sums of bytes: over cells of the dimension, over hashes of the text
inside the cell the border falls into, and over hashes of the row inside that. Whole cells of the
second kind move together while the imbalance stays below ``TOLERANCE`` of a shard, so equal texts
share a shard except where their group is larger than that. Only one row per node and step reaches
the driver; nodes are bounded by the number of shards, and their table is what is broadcast.

Defined cases: a null text has no bytes; null metadata lies at 0; rows with the same point differ
by their hashes; equal texts take the least metadata of their group; repeated rows of one id and
text cannot be told apart and share a shard. An empty table stays empty. Columns of the input that
clash with the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import text_of, without
from corpusloom.operators.order import with_row_index
from corpusloom.session import cut_lineage

CELLS, TEXT_CELLS = 4_096, 65_536
TOLERANCE = 0.02
MAX_SHARDS = 100_000
ADDED = ("size", "text_crc32", "shard", "slot")


def code_of(values: DataFrame, name: str) -> DataFrame:
    """(name, code): the values of a column in order, spread evenly over 0 to 1; null is at 0."""
    distinct = cut_lineage(values.select(name).distinct(), "shard-values")
    ranked = with_row_index(distinct, [F.col(name).isNotNull().cast("int"), F.coalesce(F.col(name).cast("string"), F.lit(""))], "__rank")
    top = max(1, distinct.count() - 1)
    return cut_lineage(ranked.select(name, (F.col("__rank") / top).alias("code")), "shard-codes")


def points(docs: DataFrame, text: str, key: str, categories: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """One narrow row per document: key, size, text_crc32, hashes, one value from 0 to 1 per dimension.

    Dimensions are the categories and the logarithm of the size.
    """
    t = text_of(text)
    base = docs.select(
        F.col(key).alias("__key"),
        *[F.col(c).alias(f"c_{c}") for c in categories],
        (F.octet_length(t) + 8).cast("bigint").alias("size"),
        F.crc32(t).alias("text_crc32"),
        F.xxhash64(t).alias("text_hash"),
    )
    base = cut_lineage(base, "shard-rows")
    coded = base
    for c in categories:
        codes = code_of(base, f"c_{c}")
        coded = coded.join(codes.withColumnsRenamed({f"c_{c}": "__v", "code": f"d_{c}"}), F.col(f"c_{c}").eqNullSafe(F.col("__v")))
        coded = coded.drop("__v", f"c_{c}")
    top = base.agg(F.max(F.log("size"))).first()[0] or 1.0
    dims = [f"d_{c}" for c in categories] + ["d_size"]
    coded = coded.withColumn("d_size", F.log("size") / F.lit(float(top)))
    # The partial minima run before the shuffle, so a group of very many copies is no burden here;
    # the join back is one that Spark can split.
    group = ["text_hash", "text_crc32", "size"]
    least = coded.groupBy(*group).agg(*[F.min(d).alias(d) for d in dims])
    out = coded.select("__key", *group).join(least, group)
    out = out.withColumns(
        {
            "__text_cell": F.pmod(F.xxhash64("text_hash", "text_crc32"), F.lit(TEXT_CELLS)).cast("int"),
            "__row_cell": F.pmod(F.xxhash64("__key", "text_hash", F.lit(1)), F.lit(CELLS)).cast("int"),
        }
    )
    return cut_lineage(out, "shard-points"), dims


@dataclass
class Split:
    """Rows go left below ``cell``; in it below ``text_cell``; in that below ``row_cell``."""

    node: int
    dim: int
    shards: int
    cell: int = 0
    text_cell: int = 0
    row_cell: int = 0


def _borders(cells: DataFrame, by: list[str], cell: str, goal: str) -> dict[tuple, tuple[int, int, int]]:
    """Per group the cell in which the running sum of ``bytes`` passes the goal: (cell, bytes before it, bytes in it)."""
    run = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("upto", F.sum("bytes").over(run))
    passed = summed.where(F.col("upto") > F.col(goal)).groupBy(*by).agg(F.min(F.struct(cell, "upto", "bytes")).alias("b"))
    return {r["node"]: (r.b[cell], r.b.upto - r.b.bytes, r.b.bytes) for r in passed.collect()}


def _cell(dims: list[str], dim: Column) -> Column:
    value = F.get(F.array(*dims), dim)
    return F.least((value * CELLS).cast("int"), F.lit(CELLS - 1))


def kd_shards(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) to rows with size, dimensions and the two hash cells."""
    spark = rows.sparkSession
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be between 1 and {MAX_SHARDS}")
    placed = rows.withColumns({"node": F.lit(0), "first": F.lit(0)})
    open_nodes = {0: shards} if shards > 1 else {}
    per_shard = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    schema = "node int, dim int, cell int, text_cell int, row_cell int, left int, right int, skip int"
    while open_nodes:
        table = lambda items, names: F.broadcast(spark.createDataFrame(items, names))  # noqa: E731  at most one row per shard
        live = placed.join(table([(n,) for n in open_nodes], "node int"), "node")
        wide = live.groupBy("node").agg(
            F.sum("size").alias("bytes"), F.array(*[F.max(d) - F.min(d) for d in dims]).alias("spread")
        )
        splits, goals = {}, {}
        for r in wide.collect():
            splits[r.node] = Split(r.node, max(range(len(dims)), key=lambda i: r.spread[i]), open_nodes[r.node])
            goals[r.node] = r.bytes * ((open_nodes[r.node] + 1) // 2) / open_nodes[r.node]
        given = table([(n, s.dim, goals[n]) for n, s in splits.items()] or [(-1, 0, 0.0)], "node int, dim int, goal double")
        cells = live.join(given, "node").withColumn("cell", _cell(dims, F.col("dim")))
        found = _borders(cells.groupBy("node", "cell", "goal").agg(F.sum("size").alias("bytes")), ["node"], "cell", "goal")
        for n, (cell, before, _) in found.items():
            splits[n].cell = cell
            goals[n] -= before
        inner = table([(n, splits[n].dim, splits[n].cell, goals[n]) for n in found] or [(-1, 0, 0, 0.0)], "node int, dim int, cell int, goal double")
        inside = live.join(inner, "node").where(_cell(dims, F.col("dim")) == F.col("cell"))
        found = _borders(inside.groupBy("node", "__text_cell", "goal").agg(F.sum("size").alias("bytes")), ["node"], "__text_cell", "goal")
        heavy = {}
        for n, (cell, before, size) in found.items():
            rest = goals[n] - before
            if min(rest, size - rest) <= TOLERANCE * per_shard:
                splits[n].text_cell = cell + (rest > size / 2)
            else:
                splits[n].text_cell, heavy[n] = cell, rest
        if heavy:
            inner = table([(n, splits[n].dim, splits[n].cell, splits[n].text_cell, g) for n, g in heavy.items()], "node int, dim int, cell int, text_cell int, goal double")
            inside = live.join(inner, "node").where((_cell(dims, F.col("dim")) == F.col("cell")) & (F.col("__text_cell") == F.col("text_cell")))
            found = _borders(inside.groupBy("node", "__row_cell", "goal").agg(F.sum("size").alias("bytes")), ["node"], "__row_cell", "goal")
            for n, (cell, before, size) in found.items():
                splits[n].row_cell = cell + (heavy[n] - before > size / 2)
        new, rows_out, number = {}, [], max(open_nodes) + 1
        for s in splits.values():
            left = (s.shards + 1) // 2
            rows_out.append((s.node, s.dim, s.cell, s.text_cell, s.row_cell, number, number + 1, left))
            new |= {number: left, number + 1: s.shards - left}
            number += 2
        tree = table(rows_out or [(-1, 0, 0, 0, 0, -1, -1, 0)], schema)
        at = F.struct(_cell(dims, F.col("dim")).alias("a"), F.col("__text_cell").alias("b"), F.col("__row_cell").alias("c"))
        goes_left = at < F.struct("cell", "text_cell", "row_cell")
        placed = placed.join(tree, "node", "left").select(
            *rows.columns,
            F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.when(goes_left, F.col("left")).otherwise(F.col("right"))).alias("node"),
            (F.col("first") + F.when(F.col("dim").isNull() | goes_left, F.lit(0)).otherwise(F.col("skip"))).alias("first"),
        )
        # The node of a row is written per level, so that a level repeats no join of those before it.
        placed = cut_lineage(placed, "shard-level")
        open_nodes = {n: k for n, k in new.items() if k > 1}
    return placed.withColumnRenamed("first", "shard").drop("node")


def shard_documents(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    text: str = "text",
    key: str = "doc_id",
    categories: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every document; join by key to move the texts.

    ``target_bytes`` asks for as many shards as hold about so many bytes each. ``slot`` counts the
    rows of a shard from 0, equal texts side by side.
    """
    rows, dims = points(without(docs, *(c for c in ADDED if c not in (text, key, *categories))), text, key, categories)
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, round((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = kd_shards(rows, dims, shards)
    # Rows are numbered by ranges of the whole order, however large a shard is; a shard begins
    # where the rows of those before it end (one row per shard).
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard").count().select("shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    numbered = with_row_index(placed, ["shard", "text_hash", "text_crc32", "__key"], "__at").join(F.broadcast(starts), "shard")
    return numbered.select(
        F.col("__key").alias(key), "size", "text_crc32", "shard", (F.col("__at") - F.col("__start")).cast("bigint").alias("slot")
    )
