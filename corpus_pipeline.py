"""Documents to training data in five stages, each a Spark job whose result is a table.

Quality rules, language identification, n-gram near-duplicates, mixing of sources, pieces. Every
stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import language_id, mixing, ngram_join, pieces, quality_rules
from corpusloom.llm.catalog import held_out, piece_model
from corpusloom.llm.common import table
from corpusloom.session import scratch_path, ship_package

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive thresholds of their language and source."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was told without doubt; ``lang`` becomes the one told."""
    ship_package(spark)
    told = language_id.predict(docs, language_id.fit(docs, ~held_out()))
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return ngram_join.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the ratio of their weights, none more than three times; repeats are rows."""
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids with begin and end id, and the byte spans of the pieces."""
    ship_package(spark)
    encoded = pieces.encode_pieces(docs, piece_model())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "starts", "ends")


STAGES = [
    ("quality rules", keep_quality),
    ("language identification", keep_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("pieces", to_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written below the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
