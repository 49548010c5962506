"""Queries of the merge-list tokenizer; their SQL does one merge per chained table.

Those of ``FULL`` merges, a usual number, have no SQL; one-by-one training and merging in plain
Python stand beside them in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import join_ids, words
from corpusloom.operators import bpe
from corpusloom.operators.tokenize import BpeTokenizer, byte_level_split, decode, encode, roundtrip_report
from corpusloom.plans import sql_parts as q
from corpusloom.plans.catalog import documents
from corpusloom.plans.registry import ORACLES, query
from corpusloom.session import scratch_path
from corpusloom.sources.vocab_files import read_vocab, write_vocab

MERGES, FULL = 32, 5_000
FIRST = 5  # ids below are those of the special tokens of the rows
MARKED = "chr(2) || {} || chr(3)"


def _rounds_sql() -> str:
    """CTEs ``w0`` to ``wN (t, n, s)``, words as marked symbols, and ``p0`` to ``pN-1 (l, r)``, the merges."""
    symbols = "string_split(s[2:-2], chr(3) || chr(2))"
    parts = [
        q.tokens("documents", "doc_id"),
        """w0 AS MATERIALIZED (SELECT t, n, array_to_string(list_transform(string_split(t, ''), lambda c: chr(2) || c || chr(3)), '') AS s
          FROM (SELECT t, count(*) AS n FROM tok GROUP BY t))""",
    ]
    for k in range(MERGES):
        parts.append(
            f"""p{k} AS MATERIALIZED (SELECT x[i] AS l, x[i + 1] AS r FROM (
              SELECT x, n, unnest(range(1, len(x))) AS i FROM (SELECT {symbols} AS x, n FROM w{k}))
              GROUP BY 1, 2 ORDER BY sum(n) DESC, l, r LIMIT 1),
            w{k + 1} AS MATERIALIZED (SELECT t, n, replace(s, {MARKED.format('l')} || {MARKED.format('r')}, {MARKED.format('l || r')}) AS s
              FROM w{k}, p{k})"""
        )
    return ",\n".join(parts)


ROUNDS = _rounds_sql()
LIST = " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right" FROM p{k}' for k in range(MERGES))
ORACLES["train_bpe"] = f"WITH {ROUNDS} {LIST}"

ENCODED = f"""WITH {ROUNDS}, m AS ({LIST}),
    singles AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM w0)),
    joined AS (SELECT c, row_number() OVER (ORDER BY rank) AS k FROM (SELECT "left" || "right" AS c, min(rank) AS rank FROM m GROUP BY 1)),
    v AS (SELECT c, {FIRST} + k AS id FROM singles UNION ALL SELECT c, {FIRST} + k + (SELECT count(*) FROM singles) FROM joined),
    u AS (SELECT t, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT t, string_split(s[2:-2], chr(3) || chr(2)) AS x FROM w{MERGES})),
    ids AS (SELECT t, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM u JOIN v USING (c) GROUP BY t)"""


def bpe_tokenizer(spark, d, max_merges: int = MERGES) -> BpeTokenizer:
    vocab, merges = bpe.train_bpe(documents(spark, d), "text", max_merges=max_merges)
    return BpeTokenizer(vocab.withColumn("id", F.col("id") + FIRST), merges, split=words, byte_level=False)


@query(
    "encode_bpe",
    f"""{ENCODED} SELECT doc_id, coalesce(string_agg(ids, ' ' ORDER BY pos), '') AS input_ids
    FROM documents LEFT JOIN tok USING (doc_id) LEFT JOIN ids USING (t) GROUP BY doc_id""",
)
def _encode_bpe(spark, d):
    ids = encode(documents(spark, d), "text", bpe_tokenizer(spark, d), attention_mask=False, keep_source=("doc_id",))
    return ids.select("doc_id", join_ids("input_ids").alias("input_ids"))


@query(
    "decode_bpe",
    f"""WITH {q.tokens('documents', 'doc_id')} SELECT doc_id, coalesce(string_agg(t, '' ORDER BY pos), '') AS text
    FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id""",
)
def _decode_bpe(spark, d):
    tok = bpe_tokenizer(spark, d)
    ids = encode(documents(spark, d), "text", tok, attention_mask=False, keep_source=("doc_id",))
    return decode(ids, "input_ids", tok).select("doc_id", "text")


@query("roundtrip_bpe", "SELECT count(*) AS rows, 0::BIGINT AS mismatched_rows FROM documents")
def _roundtrip_bpe(spark, d):
    """Byte-level pieces come back as the text they were made from; the merges fill a whole vocabulary."""
    vocab, merges = bpe.train_bpe(documents(spark, d), "text", split=byte_level_split)
    tok = BpeTokenizer(vocab.withColumn("id", F.col("id") + FIRST), merges)
    return roundtrip_report(documents(spark, d), "text", tok).select("rows", "mismatched_rows")


@query("train_bpe_full")
def _train_bpe_full(spark, d):
    return bpe.train_bpe(documents(spark, d), "text", max_merges=FULL)[1]


@query("encode_bpe_full")
def _encode_bpe_full(spark, d):
    tok = bpe_tokenizer(spark, d, FULL)
    ids = encode(documents(spark, d), "text", tok, attention_mask=False, keep_source=("doc_id",))
    return ids.select("doc_id", join_ids("input_ids").alias("input_ids"))


def merges_from_file(spark, d, max_merges: int):
    """The merge list after a way through a tokenizer file."""
    path = scratch_path(spark, "merge-file")
    write_vocab(*bpe.train_bpe(documents(spark, d), "text", max_merges=max_merges), path)
    return read_vocab(spark, path)[1]


@query("merge_file", ORACLES["train_bpe"])
def _merge_file(spark, d):
    return merges_from_file(spark, d, MERGES)


@query("merge_file_full")
def _merge_file_full(spark, d):
    return merges_from_file(spark, d, FULL)
