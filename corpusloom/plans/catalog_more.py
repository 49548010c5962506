"""Registered queries over whole tables for sources, sinks, user functions and the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.sequences import argmax
from corpusloom.functions.text import join_ids
from corpusloom.operators import evaluate, predict
from corpusloom.operators.filters import drop_source, resolve_text_column
from corpusloom.operators.order import with_row_index
from corpusloom.operators.pack import pack
from corpusloom.operators.tokenize import encode
from corpusloom.operators.userfn import map_batches
from corpusloom.plans import sql_parts as q
from corpusloom.plans.catalog import (
    BLOCK,
    DOCS,
    HIDE_PAD,
    HISTORY_SIDES,
    IGNORED_SOURCE,
    SOURCE,
    SPECIAL,
    TARGET,
    TOTAL,
    _rows_sql,
    as_text,
    conversation_tokenizer,
    document_tokenizer,
    encoded_documents,
    instructions,
    streamed,
)
from corpusloom.plans.registry import query, table
from corpusloom.session import cut_lineage, scratch_path
from corpusloom.sources import materialize, read_named, write_metrics
from corpusloom.sources.vocab_files import read_vocab, write_vocab
from corpusloom.streaming import pack_stream, read_stream, run_available


@query("read_named", "SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def _read_named(spark, d):
    root = scratch_path(spark, "named")
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    table(spark, d, "documents").withColumn("split", split).write.partitionBy("split").parquet(f"{root}/small")
    parts = [read_named(spark, root, "small", name).select("doc_id", "text", F.lit(name).alias("split")) for name in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("write_metrics", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, max(length(text))::INT AS longest FROM documents")
def _write_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    docs = table(spark, d, "documents")
    write_metrics(docs.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max(F.length("text")).alias("longest")), path)
    return spark.read.schema("n bigint, chars bigint, longest int").json(path)


@query("vocab_file", f"WITH {q.tokens('documents', 'doc_id')}, {q.vocab()} SELECT t AS token, id FROM vocab")
def _vocab_file(spark, d):
    path = scratch_path(spark, "vocab-file")
    write_vocab(document_tokenizer(spark, d).vocab, None, path)
    return read_vocab(spark, path)[0].select("token", F.col("id").cast("int").alias("id"))


@query("resolve_text", "SELECT text AS found, NULL::VARCHAR AS first FROM documents UNION ALL SELECT NULL, html FROM pages")
def _resolve_text(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages").select("html", "page_id")
    with_text = docs.select(F.col(resolve_text_column(docs)).alias("found"), F.lit(None).cast("string").alias("first"))
    return with_text.unionByName(pages.select(F.lit(None).cast("string").alias("found"), F.col(resolve_text_column(pages)).alias("first")))


@query("drop_source", "SELECT doc_id, length(text)::INT AS size FROM documents")
def _drop_source(spark, d):
    return drop_source(table(spark, d, "documents").withColumn("size", F.length("text")), ["size"], ("doc_id",))


@query(
    "materialize",
    """SELECT 'all' AS part, doc_id FROM documents UNION ALL SELECT 'even', doc_id FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'again', doc_id FROM documents""",
)
def _materialize(spark, d):
    """Two inputs below one path, and the first once more from what was written."""
    path, docs = scratch_path(spark, "prepared"), table(spark, d, "documents").select("doc_id")
    parts = {"all": docs, "even": docs.where("doc_id % 2 = 0"), "again": docs}
    out = [materialize(df, path, kind="ids").select(F.lit(name).alias("part"), "doc_id") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "map_batches",
    """SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1152921504606846977 + doc_id END AS big, upper(source) AS source,
      length(text)::BIGINT AS size FROM documents""",
)
def _map_batches(spark, d):
    big = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") + F.lit(2**60 + 1))
    rows = table(spark, d, "documents").select(big.alias("big"), "source", "text")

    def sizes(columns):
        return {"big": columns["big"], "source": [s.upper() for s in columns["source"]], "size": [len(t) for t in columns["text"]]}

    return map_batches(rows, sizes, "big bigint, source string, size bigint")


@query(
    "predict_passthrough",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1152921504606846977 + doc_id END AS big,
      concat(source, '/', length(text)) AS out_text FROM documents""",
)
def _predict_passthrough(spark, d):
    big = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") + F.lit(2**60 + 1))
    rows = table(spark, d, "documents").select("doc_id", big.alias("big"), "source", "text", F.col("source").alias("path"))

    def factory(adapter, path):
        return lambda prompts: [f"{path}/{len(p)}" for p in prompts]

    return predict.predict(rows, factory, "text", adapter="source", path="path").select("doc_id", "big", "out_text")


@query("batch_metric", "SELECT avg((list_position(embedding, list_max(embedding)) - 1 = label)::INT) AS score FROM embeddings")
def _batch_metric(spark, d):
    rows = table(spark, d, "embeddings").select(argmax(F.col("embedding")).alias("preds"), F.col("label").alias("labels"))

    def sums(batch):
        return {"hits": int((batch["preds"] == batch["labels"]).sum()), "n": len(batch)}

    return evaluate.batch_metric(rows, sums, ["hits", "n"], lambda c: c["hits"] / c["n"], "score")


PREPARED = _rows_sql(
    HISTORY_SIDES,
    f"list_concat({q.cut('a', SOURCE - 1)}, [4])",
    f"list_concat(list_concat([1], {q.cut('b', TARGET - 2)}), [2])",
    q.pad("list_concat(x, y)", TOTAL, 0),
    HIDE_PAD.format(q.pad(f"list_concat({IGNORED_SOURCE}, y)", TOTAL, 0)),
)


@query("prepare", f"SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM ({PREPARED})")
def _prepare(spark, d):
    tok = conversation_tokenizer(spark, d)
    split = F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train")
    rows = cut_lineage(instructions(spark, d, SOURCE, tok).withColumn("split", split), "instructions")
    options = dict(max_source=SOURCE, max_target=TARGET, tokenizer=tok, keep_source=("conv_id", "turn"))
    parts = [predict.prepare(rows, name, **options).withColumn("split", F.lit(name)) for name in ("train", "test")]
    return as_text(parts[0].unionByName(parts[1]), "input_ids", "labels")


@query(
    "pack_global",
    f"""WITH {DOCS}, {q.packed('ids', BLOCK, 10**12, True)}
    SELECT block_id, {q.text_of('ids')} AS input_ids, {q.text_of('ids')} AS labels FROM blk""",
)
def _pack_global(spark, d):
    indexed = with_row_index(encoded_documents(spark, d, attention_mask=False), "doc_id").drop("doc_id")
    packed = pack(cut_lineage(indexed, "indexed"), BLOCK, batch_rows=None)
    return as_text(packed.select("block_id", "input_ids", "labels"), "input_ids", "labels")


def _carried_sql(ids: str, more: str = "") -> str:
    return f"""WITH {DOCS}, t AS (SELECT source, doc_id, unnest({ids}) AS id, generate_subscripts({ids}, 1) AS p
      FROM enc JOIN documents USING (doc_id)),
    g AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1 AS pos,
      count(*) OVER (PARTITION BY source) AS total FROM t)
    SELECT source, pos // {BLOCK} AS block_id, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS input_ids{more}
    FROM g WHERE pos < total // {BLOCK} * {BLOCK} GROUP BY 1, 2"""


@query("stream_pack_carry", _carried_sql("ids"))
def _stream_pack_carry(spark, d):
    tok = document_tokenizer(spark, d)
    ids = encode(streamed(spark, d, "documents"), "text", tok, attention_mask=False, keep_source=("doc_id", "source"))
    blocks = pack_stream(ids, BLOCK, carry=True, by="source", order="doc_id")
    out = run_available(blocks, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))
    return out.select("source", "block_id", join_ids("input_ids").alias("input_ids"))


ARRIVALS = 4


@query("stream_pack_files", _carried_sql(SPECIAL, ", string_agg((id IN (1, 2))::INT::VARCHAR, ' ' ORDER BY pos) AS special_tokens_mask"))
def _stream_pack_files(spark, d):
    """Masked rows with their special mask; files arrive four times, and the stream goes on each time."""
    docs, path = table(spark, d, "documents").select("doc_id", "source", "text"), scratch_path(spark, "arriving")
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    part = F.least(F.floor((F.col("doc_id") - ends.lo) * ARRIVALS / F.lit(ends.hi - ends.lo + 1)), F.lit(ARRIVALS - 1))
    tok, done, state = document_tokenizer(spark, d), scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    options = dict(special=True, special_mask=True, attention_mask=False, keep_source=("doc_id", "source"))
    for i in range(ARRIVALS):
        docs.where(part == i).write.mode("append").parquet(path)
        ids = encode(read_stream(spark, path, "parquet", docs.schema), "text", tok, **options)
        blocks = pack_stream(ids, BLOCK, carry=True, by="source", order="doc_id", column=("input_ids", "special_tokens_mask"), labels=False)
        out = run_available(blocks, done, state)
    return as_text(out, "input_ids", "special_tokens_mask")
