"""Streaming scans and a helper to run a stream over the files present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusloom.streaming.pack import CarriedBlocks

FORMATS = ("json", "csv", "text", "parquet")


def read_stream(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | str | None = None,
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """New files of a folder as a stream. All formats but text need a schema, as nothing is inferred.

    Row-wise operators (templates, encode, the instruction layouts) take the result as it is.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, known: {', '.join(FORMATS)}")
    reader = spark.readStream.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt != "text":
        raise ValueError("a streaming scan needs a schema")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    out = reader.options(**options).load(path)
    return out.withColumnRenamed("value", "text") if fmt == "text" and schema is None else out


def run_available(df: DataFrame | CarriedBlocks, path: str, checkpoint: str) -> DataFrame:
    """Write everything a stream has now to parquet and read it back."""
    if isinstance(df, CarriedBlocks):
        return df.run(path, checkpoint)
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
