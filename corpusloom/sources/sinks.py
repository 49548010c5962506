"""Writers and the prepared-data cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import is_written


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row with every field, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metrics frame, one or a few rows, as one JSON file."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def fingerprint(**params) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def input_identity(df: DataFrame) -> str:
    """What a frame reads: its plan, and path, size and time of every file, summed by Spark.

    A plan without files (rows made by the session) is told apart by its own identity.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed().canonicalized().toString()
    files = df.inputFiles()
    if not files:
        return f"{plan} {df.semanticHash()}"
    found = spark.read.format("binaryFile").load(files).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    row = found.agg(F.sum("h").alias("sum"), F.count("*").alias("n")).first()
    return f"{plan} {row.n} {row['sum']}"


def materialize(df: DataFrame, path: str, overwrite: bool = False, **params) -> DataFrame:
    """Write ``df`` below ``path`` once and read it back; later calls with equal input and parameters
    reuse it.

    The folder name is made from both, so other data and other settings never meet old results.
    Output is partitioned by ``split`` where there is such a column, so reading one split skips the
    others.
    """
    target = f"{path.rstrip('/')}/{fingerprint(columns=df.dtypes, input=input_identity(df), **params)}"
    if overwrite or not is_written(df.sparkSession, target):
        writer = df.write.mode("overwrite")
        if "split" in df.columns:
            writer = writer.partitionBy("split")
        writer.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target).select(*[F.col(c) for c in df.columns])
