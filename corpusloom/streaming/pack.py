"""Packing a stream of tokenized rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from corpusloom.operators.order import Keys, with_row_index
from corpusloom.operators.pack import BATCH_ROWS, _pieces, pack
from corpusloom.session import cut_lineage


def packed_batches(
    path: str, block_size: int, order_by: Keys, batch_rows: int = BATCH_ROWS, **options
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: index and pack one micro-batch.

    Each micro-batch owns one folder and overwrites it when it is run again after a failure, so
    every block is written once.
    """

    def write(batch: DataFrame, batch_no: int) -> None:
        # The batch is a finished plan that would run again, unpruned, for every pass over it.
        indexed = with_row_index(cut_lineage(batch, "micro-batch"), order_by)
        blocks = pack(indexed, block_size, batch_rows, **options)
        blocks.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_no}")

    return write


@dataclass(frozen=True)
class CarriedBlocks:
    """Blocks of a stream whose rest is carried on per value of ``by``; ``run_available`` writes them."""

    rows: DataFrame
    block_size: int
    by: str
    columns: tuple[str, ...]
    order: str
    labels: bool = True

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def schema(self) -> T.StructType:
        ids = T.ArrayType(T.IntegerType())
        lists = [*self.columns, *(["labels"] if self.labels else [])]
        fields = [(self.by, self.rows.schema[self.by].dataType), ("block_id", T.LongType()), *[(c, ids) for c in lists]]
        return T.StructType([T.StructField(name, kind) for name, kind in fields])

    def writer(self, path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` function: blocks of one micro-batch below ``path``, the rest below ``checkpoint``.

        A micro-batch reads the rest that the one before left and overwrites the folders of its own,
        so one that is run again after a failure gives the same. Two rests are kept in turn.
        """
        state = f"{checkpoint.rstrip('/')}/carry"
        # Lists go by number inside, whatever their names are.
        lists, empty = [f"list{i}" for i in range(len(self.columns))], F.array().cast("array<int>")
        tails = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists]
        kept = T.StructType([self.schema[self.by], T.StructField("made", T.LongType()), *tails])

        def write(batch: DataFrame, batch_no: int) -> None:
            spark = batch.sparkSession
            given = [F.coalesce(F.col(c).cast("array<int>"), empty).alias(name) for c, name in zip(self.columns, lists)]
            rows = batch.select(F.col(self.by).alias("by"), F.lit(1).alias("turn"), F.col(self.order).alias("order"), *given, F.lit(0).cast("bigint").alias("made"))
            if batch_no:
                # The rest goes before all rows of its value, at the place its first token has in the whole stream.
                before = spark.read.schema(kept).parquet(f"{state}/{(batch_no - 1) % 2}")
                none = F.lit(None).cast(rows.schema["order"].dataType)
                rows = rows.unionByName(before.select(F.col(self.by).alias("by"), F.lit(0).alias("turn"), none.alias("order"), *lists, "made"))
            size = F.size(lists[0]).cast("bigint")
            alike = F.lit(True)
            for c in lists[1:]:
                alike = alike & (F.size(c) == size)
            size = F.when(alike, size).otherwise(F.raise_error(F.lit("lists of a row differ in length")).cast("bigint"))
            rows = rows.withColumns({"n": size, "tie": F.xxhash64(*lists)})
            placed, totals = _places(cut_lineage(rows, "micro-batch"), self.block_size, lists)
            pieces = _pieces(placed, lists, self.block_size, F.col("end"), ["by"], "row")
            blocks = cut_lineage(pieces, "carried-blocks")
            whole = F.size(lists[0]) == self.block_size
            named = [F.col(name).alias(c) for c, name in zip(self.columns, lists)]
            same = [F.col(lists[0]).alias("labels")] if self.labels else []
            out = blocks.where(whole).select(F.col("by").alias(self.by), "block_id", *named, *same)
            out.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_no}")
            rest = blocks.where(~whole).select(F.col("by").alias("of"), *lists)
            left = totals.join(rest, F.col("by").eqNullSafe(F.col("of")), "left").select(
                F.col("by").alias(self.by),
                F.expr(f"total div {self.block_size}").alias("made"),
                *[F.coalesce(c, empty).alias(c) for c in lists],
            )
            left.write.mode("overwrite").parquet(f"{state}/{batch_no % 2}")

        return write

    def run(self, path: str, checkpoint: str) -> DataFrame:
        """Pack what the stream has now and read all blocks written so far."""
        write = self.writer(path, checkpoint)
        stream = self.rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
        spark = self.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(path).select(*self.schema.names)


def _places(rows: DataFrame, block_size: int, lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``row``, ``start`` and ``end``, the token positions in their value of ``by``; and the total per value.

    Positions count from the first token of the stream: a row weighs its tokens and those of the
    ``made`` blocks before it. Rows are put in order by range, so a value with many rows is spread
    over many tasks; at most one value of a range has rows in the ranges before it.
    """
    keys = ["by", "turn", F.col("order").isNull(), "order", "tie"]
    indexed = with_row_index(rows, keys, "row", range_col="part")
    indexed = indexed.withColumn("weight", F.col("n") + F.col("made") * block_size)
    sums = cut_lineage(indexed.groupBy("part", "by").agg(F.sum("weight").alias("weight")), "carried-sums")
    before = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("in_part"), F.col("by").alias("of"), F.sum("weight").over(before).alias("offset"))
    offsets = F.broadcast(offsets.where(F.col("offset").isNotNull()))
    inside = Window.partitionBy("part", "by").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        indexed.withColumn("run", F.sum("weight").over(inside))
        .join(offsets, (F.col("part") == F.col("in_part")) & F.col("by").eqNullSafe(F.col("of")), "left")
        .withColumn("end", F.coalesce("offset", F.lit(0)) + F.col("run"))
        .withColumn("start", F.col("end") - F.col("n"))
    )
    return placed.select("by", "row", "n", *lists, "start", "end"), sums.groupBy("by").agg(F.sum("weight").alias("total"))


def pack_stream(
    df: DataFrame,
    block_size: int,
    order_by: Keys | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
    batch_rows: int = BATCH_ROWS,
    carry: bool = False,
    by: str = "shard",
    column: str | Sequence[str] = "input_ids",
    order: str = "row_idx",
    labels: bool = True,
    **options,
):
    """Pack rows as they arrive.

    By default every micro-batch is indexed and packed like a table of its own and written below
    ``path``; the rest of each batch of rows is dropped. Returns the started query, which handles
    what is there now and stops.

    With ``carry`` the result is for ``run_available``: the rest is kept per value of ``by`` for the
    next micro-batch and no token is lost. The state of a value is less than one block and a count.
    A value may hold any share of the rows: they are put in order by range and cut into pieces of
    blocks in Spark, so no task holds a value whole. Rows of a value with equal ``order`` are put in
    the order of their hashes. ``column`` names one list column or several, which are cut alike;
    ``labels`` adds the first as labels.
    """
    if not df.isStreaming:
        raise ValueError("pack_stream needs a streaming frame; use pack for tables")
    if carry:
        columns = (column,) if isinstance(column, str) else tuple(column)
        return CarriedBlocks(df.select(by, order, *columns), block_size, by, columns, order, labels)
    return (
        df.writeStream.foreachBatch(packed_batches(path, block_size, order_by, batch_rows, labels=labels, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def shard(key: str, shards: int):
    """A hash shard of the row key, as ``by`` for ``pack_stream``."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
