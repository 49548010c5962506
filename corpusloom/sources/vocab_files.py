"""Tokenizer JSON files: vocabulary and merge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

MAX_FILE_ENTRIES = 2_000_000

_MODEL = "struct<model: struct<vocab: map<string,int>, merges: array<string>>>"


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(token, id)`` and ``(rank, left, right)`` of a tokenizer file.

    The file may hold the tokenizer object (``model.vocab``, ``model.merges``) or just the
    vocabulary object; the merge table is then empty.
    """
    text = spark.read.text(path, wholetext=True)
    model = F.from_json("value", _MODEL)["model"]
    plain = F.from_json("value", "map<string,int>", {"mode": "PERMISSIVE"})
    tables = text.select(model.alias("m"), plain.alias("p"))
    vocab = tables.select(F.explode(F.coalesce("m.vocab", "p")).alias("token", "id"))
    merge = F.split("merge", " ", 2)
    merges = tables.select(F.posexplode("m.merges").alias("rank", "merge")).select(
        "rank", merge[0].alias("left"), F.get(merge, F.lit(1)).alias("right")
    )
    return vocab, merges


def write_vocab(vocab: DataFrame, merges: DataFrame | None, path: str, mode: str = "errorifexists") -> None:
    """One JSON object with the vocabulary in id order and the merges in rank order.

    The file is one value, so its size is checked first.
    """
    if vocab.count() > MAX_FILE_ENTRIES or (merges is not None and merges.count() > MAX_FILE_ENTRIES):
        raise ValueError(f"a tokenizer file holds at most {MAX_FILE_ENTRIES} entries")
    entries = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("e")).select(
        F.map_from_entries(F.transform("e", lambda e: F.struct(e["token"], e["id"]))).alias("vocab")
    )
    if merges is None:
        body = entries.withColumn("merges", F.array().cast(T.ArrayType(T.StringType())))
    else:
        listed = merges.agg(
            F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "left", "right").alias("m")))).alias("l")
        ).select(F.transform("l", lambda m: m["m"]).alias("merges"))
        body = entries.join(listed)  # one row each
    value = F.to_json(F.struct(F.struct("vocab", "merges").alias("model")))
    body.select(value.alias("value")).coalesce(1).write.mode(mode).text(path)
