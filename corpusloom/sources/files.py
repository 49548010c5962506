"""Text, CSV, JSON-lines and named table scans; several splits in one table."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from corpusloom.session import cut_lineage

Schema = T.StructType | str | None
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _by_last_line(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """Files that end in a line break, and files that do not; Spark adds up the bytes of each.

    A file is as long as its lines with one break behind each. One byte less says that the last
    break is missing, unless the last line ends in ``\\r``.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value", at.alias("at")
    )
    sums = lines.groupBy("file", "size").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max_by(F.col("value").endswith("\r"), "at").alias("cr")
    )
    found = sums.select("file", ((F.col("bytes") > F.col("size")) & ~F.col("cr")).alias("ragged")).collect()
    names = lambda ragged: [unquote(r.file) for r in found if r.ragged == ragged]
    return names(False), names(True)


def read_text(spark: SparkSession, path: str | list[str], keep_linebreaks: bool = True, position: bool = False) -> DataFrame:
    """One row per line in column ``text``; with ``keep_linebreaks`` each value ends in its newline.

    All usual line ends count and become ``\\n``. Only the last line of a file that does not end in
    one stays bare. ``position`` adds ``src``, a struct that sorts rows in file order.
    """
    raw = spark.read.text(path)
    src = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    lines = raw.select(F.col("value").alias("text"), src.alias("src"))
    if keep_linebreaks:
        packed = [f for f in raw.inputFiles() if f.endswith(COMPRESSED)]
        if packed:
            raise ValueError(f"the end of a compressed file cannot be looked at, read without line breaks: {packed[0]}")
        broken = F.concat("text", F.lit("\n"))
        whole, ragged = _by_last_line(spark, path)
        if ragged:
            # The last line is the largest position of its file. A repeated scan may cut the
            # files elsewhere, so the rows of these files are written down first.
            fixed = cut_lineage(spark.read.text(ragged).select(F.col("value").alias("text"), src.alias("src")), "ragged")
            last = fixed.groupBy("src.file").agg(F.max("src").alias("last")).select("last")
            ends = fixed.join(last, F.col("src") == F.col("last"), "left").select(
                F.when(F.col("last").isNull(), broken).otherwise(F.col("text")).alias("text"), "src"
            )
            lines = ends
            if whole:
                rest = spark.read.text(whole).select(F.col("value").alias("text"), src.alias("src"))
                lines = rest.withColumn("text", broken).unionByName(ends)
        else:
            lines = lines.withColumn("text", broken)
    return lines if position else lines.select("text")


def read_csv(spark: SparkSession, path: str | list[str], schema: Schema = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; quoted line breaks and doubled quotes are part of the value.

    Quoted line breaks keep a file in one task, whatever its size; turn ``multi_line`` off for large
    files that have none, and Spark splits them.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: Schema = None) -> DataFrame:
    """One JSON object per line. Without a schema the files are scanned once more to infer it."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_named(spark: SparkSession, name: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """A catalog table, or a parquet directory with one folder per config; ``split`` is pruned."""
    full = f"{name}_{config}" if config else name
    if "/" not in name and spark.catalog.tableExists(full):
        df = spark.table(full)
    else:
        df = spark.read.parquet(f"{name}/{config}" if config else name)
    return df if split is None else df.where(F.col("split") == split)


def _read_by_suffix(spark: SparkSession, path: str, keep_linebreaks: bool, schema: Schema) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "txt":
        return read_text(spark, path, keep_linebreaks)
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix == "json":
        return read_jsonl(spark, path, schema)
    raise ValueError(f"{path}: need a csv, json or txt file")


def read_splits(
    spark: SparkSession,
    train: str | None = None,
    validation: str | None = None,
    test: str | None = None,
    name: str | None = None,
    config: str | None = None,
    keep_linebreaks: bool = True,
    schema: Schema = None,
) -> DataFrame:
    """Files or a named dataset as one table with a ``split`` column.

    The reader is chosen file by file from the suffix. A named dataset without a ``split`` column
    is all train.
    """
    if name is not None:
        df = read_named(spark, name, config)
        return df if "split" in df.columns else df.withColumn("split", F.lit("train"))
    files = {"train": train, "validation": validation, "test": test}
    if train is None and validation is None:
        raise ValueError("need a dataset name or a training or validation file")
    out = None
    for split, path in files.items():
        if path is None:
            continue
        df = _read_by_suffix(spark, path, keep_linebreaks, schema).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def lines_of(text: Column) -> Column:
    """The lines of a text value."""
    return F.split(text, "\r\n|\r|\n")
