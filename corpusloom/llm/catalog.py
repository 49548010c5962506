"""Registered queries of this folder: one per operator over its whole table, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import (
    bayes_dedup,
    chat,
    divergence,
    html_text,
    language_id,
    mixing,
    ngram_join,
    pieces,
    quality_model,
    quality_rules,
    sharding,
    whitening,
    winnowing,
)
from corpusloom.llm.common import table, text_of, word_count
from corpusloom.llm.sql import OP3, OP5, OP8, OP11, OP12
from corpusloom.session import cut_lineage

QUERIES = {}
ORACLES = {}


def piece_model() -> str:
    """Path of the public vocabulary the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_source_mix", OP3)
def _mix(spark, d):
    docs = table(spark, d, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", word_count(text_of("text")).alias("n_words")), "mix-sized")
    mixed = mixing.mix(sized, size=F.col("n_words"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op8_quality_rules", OP8)
def _rules(spark, d):
    judged = quality_rules.quality_rules(table(spark, d, "documents"), keep=("doc_id", "lang", "source"))
    rules = F.array_join("failed_rules", ",").alias("failed_rules")
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", rules)


@query("op5_reply_chats", OP5)
def _chats(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    messages = cut_lineage(chat.reply_chain(turns.unionByName(own)), "chat-messages")
    made = chat.format_paths(chat.best_paths(messages.select("id", "parent", "score")), messages)
    read = made.withColumns(
        {"turns": chat.parse(F.col("formatted")), "learned": chat.spans_text(F.col("formatted"), F.col("loss_spans"))}
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    conv = F.substring_index("leaf", ":", 1)
    return read.select(
        F.when(conv != "null", conv.cast("bigint")).alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op10_winnowing")
def _winnow(spark, d):
    pairs = winnowing.edited_pairs(table(spark, d, "documents").select("doc_id", "text"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text(F.col("prints")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("prints.hash"), F.col("edited_prints.hash")).alias("near_edited"),
        winnowing.likeness(F.col("prints.hash"), F.col("next_prints.hash")).alias("near_next"),
    )


@query("op9_sentencepiece")
def _pieces(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    digests = ("n_tokens", "ids_sha256", "decoded_sha256")
    return pieces.encode_pieces(docs, piece_model(), added=digests).select("doc_id", *digests)


def held_out(key: str = "doc_id"):
    """One fifth of the documents, told by their id; a row without an id is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


@query("op6_quality_discriminant")
def _quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    # The texts are read once; labels meet the short vectors only.
    measured = quality_model.with_statistics(docs).select("doc_id", held_out().alias("held_out"), "statistics")
    measured = cut_lineage(measured, "quality-statistics")
    labels = table(spark, d, "labels").where(~held_out()).select("doc_id", "quality")
    model = quality_model.fit(measured.where("not held_out").join(labels, "doc_id"))
    return quality_model.predict(measured, model).select("doc_id", "held_out", "score", "predicted")


@query("op7_language_codes")
def _language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~held_out())
    told = language_id.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op4_kd_shards")
def _shards(spark, d):
    placed = sharding.shard_documents(table(spark, d, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_ngram_join")
def _near(spark, d):
    joined = ngram_join.jaccard_classes(table(spark, d, "documents"))
    return joined.select("doc_id", "class_id", "n_copies", "n_links")


@query("op2_html_layout")
def _html(spark, d):
    return html_text.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_lines")


@query("op11_bayes_dedup", OP11)
def _bayes(spark, d):
    return bayes_dedup.near_copies(table(spark, d, "documents"))


@query("op12_source_divergence", OP12)
def _divergence(spark, d):
    return divergence.audit(table(spark, d, "documents"))


@query("op13_whitening")
def _whitening(spark, d):
    white = whitening.whiten(table(spark, d, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))
