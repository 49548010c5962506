"""Registered queries over whole tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.sequences import Specials, add_special_pair, mask_pad, pad_right, proportional_budget
from corpusloom.functions.text import join_ids
from corpusloom.operators import bpe, collate, evaluate, instruct, predict, vocab as vocabulary
from corpusloom.operators.conversation import turn_pairs, turns_to_instructions
from corpusloom.operators.filters import filter_blank, filter_pairs
from corpusloom.operators.order import preview, sample_counts, shuffle, split_percent, take_head, with_row_index
from corpusloom.operators.pack import line_rows, pack, truncate_rows
from corpusloom.operators.templates import (
    ALPACA_PREFIX,
    ALPACA_SUFFIX,
    CHAT_EN_PREFIX,
    CHAT_EN_SUFFIX,
    CHAT_PREFIX,
    CHAT_SUFFIX,
    ZIYA_PREFIX,
    ZIYA_SUFFIX,
    apply_template,
    render_history,
    template,
)
from corpusloom.operators.tokenize import WordTokenizer, decode, encode, overlength_report, roundtrip_report, with_masks
from corpusloom.plans import sql_parts as q
from corpusloom.plans.registry import query, table
from corpusloom.session import cut_lineage, is_small, scratch_path, spread_small
from corpusloom.sources import read_csv, read_jsonl, read_splits, read_text, write_jsonl
from corpusloom.sources.files import lines_of
from corpusloom.streaming import pack_stream, read_stream, run_available

SP = Specials()
VOCAB_SIZE = q.VOCAB_SIZE
IDS_END = SP.first_free + VOCAB_SIZE
BLOCK = 128
SOURCE, TARGET = 1_024, 128
BUDGETS = {"": (SOURCE, TARGET), "_short": (48, 24)}
SEED = 7


# --- shared inputs --------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread_small(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))


LINES = """lines AS (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
      FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents))"""
BLANK = f"regexp_full_match(line, '{q.SPACE_SQL}*')"


def document_tokenizer(spark: SparkSession, d: str, size: int | None = VOCAB_SIZE) -> WordTokenizer:
    return WordTokenizer(vocabulary.word_vocab(documents(spark, d), "text", size))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def conversation_tokenizer(spark: SparkSession, d: str) -> WordTokenizer:
    return WordTokenizer(vocabulary.word_vocab(conversations(spark, d), "text", VOCAB_SIZE))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(conversations(spark, d)).select("conv_id", "turn", "prompt", "response")


def instructions(spark: SparkSession, d: str, limit: int | None = None, tokenizer: WordTokenizer | None = None, **form) -> DataFrame:
    rows = turns_to_instructions(conversations(spark, d), limit=limit, tokenizer=tokenizer, **form)
    return rows.select("conv_id", "turn", "prompt", "response", "history")


def as_text(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({c: join_ids(c) for c in lists})


def encoded_documents(spark: SparkSession, d: str, **options) -> DataFrame:
    return encode(documents(spark, d), "text", document_tokenizer(spark, d), keep_source=("doc_id",), **options)


def indexed_ids(spark: SparkSession, d: str, align: int, **options) -> DataFrame:
    """Encoded documents in id order; ``rng`` lets packing and batching reuse the partitions."""
    ids = encoded_documents(spark, d, **options)
    return with_row_index(ids, "doc_id", align=align, range_col="rng").drop("doc_id")


DOCS = q.docs_encoded()


# --- sources --------------------------------------------------------------------------------------


@query(
    "read_text",
    f"WITH {LINES} SELECT line || chr(10) AS text, count(*) AS n FROM lines GROUP BY 1",
)
def _read_text(spark, d):
    path = scratch_path(spark, "text")
    document_lines(spark, d).select("line").write.text(path)
    return read_text(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("read_csv", "SELECT doc_id, text, lang, source FROM documents")
def _read_csv(spark, d):
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    docs.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return read_csv(spark, path, docs.schema)


HISTORY_TEXT = (
    "coalesce(array_to_string(list_transform(history, lambda h: concat(h[1], chr(9), h[2])), chr(10)), '')"
)


def history_text(col: str = "history") -> Column:
    return F.array_join(F.transform(col, lambda h: F.concat(h[0], F.lit("\t"), h[1])), "\n")


@query(
    "read_jsonl",
    f"WITH {q.HISTORY} SELECT conv_id, turn, prompt, response, {HISTORY_TEXT} AS history FROM hist",
)
def _read_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    write_jsonl(instructions(spark, d), path)
    schema = "conv_id bigint, turn bigint, prompt string, response string, history array<array<string>>"
    return read_jsonl(spark, path, schema).withColumn("history", history_text())


@query(
    "read_splits",
    """SELECT 'train' AS split, text FROM documents
       UNION ALL SELECT 'validation' AS split, text FROM conversations""",
)
def _read_splits(spark, d):
    # Spark writes folders; their names carry the suffix that picks the reader.
    train, validation = scratch_path(spark, "train") + ".json", scratch_path(spark, "validation") + ".csv"
    documents(spark, d).select("text").write.json(train)
    conversations(spark, d).select("text").write.options(header=True, escape='"', quoteAll=True).csv(validation)
    return read_splits(spark, train=train, validation=validation, schema="text string").select("split", "text")


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents")
def _row_index(spark, d):
    return with_row_index(documents(spark, d).select("doc_id"), "doc_id")


@query(
    "turns_to_instructions",
    f"WITH {q.HISTORY} SELECT conv_id, turn, prompt, response, {HISTORY_TEXT} AS history FROM hist",
)
def _turns_to_instructions(spark, d):
    return instructions(spark, d).withColumn("history", history_text())


# --- filters and splits ---------------------------------------------------------------------------


@query(
    "filter_pairs",
    """SELECT conv_id, turn, text AS prompt, answer AS response FROM (
         SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer,
                lead(turn) OVER w AS answer_turn
         FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       WHERE role = 'user' AND answer <> '' AND text <> ''""",
)
def _filter_pairs(spark, d):
    asked = turn_pairs(conversations(spark, d), keep_open=True)
    return filter_pairs(asked).select("conv_id", "turn", "prompt", "response")


@query("filter_blank", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE NOT {BLANK}")
def _filter_blank(spark, d):
    return filter_blank(document_lines(spark, d), "line").withColumn("line_no", F.col("line_no").cast("bigint"))


SPLIT = """sp AS (
      SELECT doc_id, text, CASE WHEN i < round_even(n * 5 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split
      FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents))"""


@query("split_percent", f"WITH {SPLIT} SELECT doc_id, split FROM sp")
def _split_percent(spark, d):
    return split_percent(documents(spark, d).select("doc_id"), 5, "doc_id")


@query(
    "head_n",
    f"WITH {SPLIT} SELECT doc_id, split, text FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM sp "
    "WHERE split = 'train') WHERE i <= 100",
)
def _head_n(spark, d):
    split = split_percent(documents(spark, d), 5, "doc_id")
    return take_head(split, 100, "train", "doc_id").select("doc_id", "split", "text")


def _template_sql(prefix: str, suffix: str, tail: str = "") -> str:
    source = f"concat({q.quoted(prefix)}, prompt, {q.quoted(suffix)})" if prefix else "prompt"
    return f"WITH {q.PAIRS} SELECT conv_id, turn, {source} AS source, response AS target FROM pairs {tail}"


@query("preview", _template_sql(ALPACA_PREFIX, ALPACA_SUFFIX, "ORDER BY conv_id, turn LIMIT 3"))
def _preview(spark, d):
    rows = apply_template(pairs(spark, d), "standard_alpaca", keep_source=("conv_id", "turn"))
    return preview(rows, 3, ["conv_id", "turn"])


# --- templates ------------------------------------------------------------------------------------


def _template_query(name: str, kind: str, prefix: str, suffix: str) -> None:
    @query(name, _template_sql(prefix, suffix))
    def run(spark, d):
        return apply_template(pairs(spark, d), kind, keep_source=("conv_id", "turn"))


_template_query("tpl_default", "default", "", "")
_template_query("tpl_alpaca", "standard_alpaca", ALPACA_PREFIX, ALPACA_SUFFIX)
_template_query("tpl_chat", "chat_prompt", CHAT_PREFIX, CHAT_SUFFIX)
_template_query("tpl_chat_en", "chat_prompt_en", CHAT_EN_PREFIX, CHAT_EN_SUFFIX)
_template_query("tpl_ziya", "ziya_prompt", ZIYA_PREFIX, ZIYA_SUFFIX)

RENDERED = q.rounds("prompt", "history", q.ROUND_FORM)
CUSTOM_FORMAT = "[{i}] Q: {q} A: {a}"
CUSTOM = q.rounds("prompt", "history", ("[", "] Q: ", " A: ", "\n\n"), first=1)


@query("history_round", f"WITH {q.HISTORY} SELECT conv_id, turn, {RENDERED} AS prompt FROM hist")
def _history_round(spark, d):
    return instructions(spark, d).select("conv_id", "turn", render_history("prompt", "history").alias("prompt"))


@query(
    "history_round_bare",
    f"WITH {q.HISTORY} SELECT conv_id, turn, CASE WHEN len(history) = 0 THEN prompt ELSE {RENDERED} END AS prompt FROM hist",
)
def _history_round_bare(spark, d):
    bare = render_history("prompt", "history", empty_as_bare=True)
    return instructions(spark, d).select("conv_id", "turn", bare.alias("prompt"))


@query("history_custom", f"WITH {q.HISTORY} SELECT conv_id, turn, {CUSTOM} AS prompt FROM hist")
def _history_custom(spark, d):
    custom = render_history("prompt", "history", turn_format=CUSTOM_FORMAT, separator="\n\n", first=1)
    return instructions(spark, d).select("conv_id", "turn", custom.alias("prompt"))


# --- tokenization ---------------------------------------------------------------------------------


@query("encode_words", f"WITH {q.docs_encoded(None)} SELECT doc_id, {q.text_of('ids')} AS input_ids FROM enc")
def _encode_words(spark, d):
    docs = documents(spark, d)
    every_word = WordTokenizer(vocabulary.word_vocab(docs, "text", None), join=True)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # an id may be there twice
    ids = encode(numbered, "text", every_word, attention_mask=False, keep_source=("doc_id",), key="row")
    return as_text(ids.drop("row"), "input_ids")


@query("encode_trunc", f"WITH {DOCS} SELECT doc_id, {q.text_of(q.cut('ids', 64))} AS input_ids FROM enc")
def _encode_trunc(spark, d):
    return as_text(encoded_documents(spark, d, max_length=64, attention_mask=False), "input_ids")


@query(
    "encode_pad",
    f"""WITH {DOCS} SELECT doc_id, {q.text_of(q.pad('ids', 256, 0))} AS input_ids,
        {q.text_of(q.pad(q.repeat(1, 'len(ids)'), 256, 0))} AS attention_mask FROM enc""",
)
def _encode_pad(spark, d):
    return as_text(encoded_documents(spark, d, pad_to=256), "input_ids", "attention_mask")


SPECIAL = "list_concat(list_concat([1], ids), [2])"


@query(
    "special_mask",
    f"""WITH {DOCS} SELECT doc_id, {q.text_of(SPECIAL)} AS input_ids,
        {q.text_of("list_concat(list_concat([1], " + q.repeat(0, "len(ids)") + "), [1])")} AS special_tokens_mask FROM enc""",
)
def _special_mask(spark, d):
    ids = encoded_documents(spark, d, special=True, special_mask=True, attention_mask=False)
    return as_text(ids, "input_ids", "special_tokens_mask")


PAIR_SIDES = f"WITH {q.PAIRS}, {q.sides('pairs', 'prompt', 'response')}"


def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    tok = conversation_tokenizer(spark, d)
    return tok.with_ids(pairs(spark, d), {"a": "prompt", "b": "response"}).select("conv_id", "turn", "a", "b")


@query(
    "special_pair",
    f"""{PAIR_SIDES} SELECT conv_id, turn,
        {q.text_of('list_concat(list_concat(list_concat(a, [4, 1]), b), [2])')} AS input_ids FROM s""",
)
def _special_pair(spark, d):
    rows = pair_ids(spark, d)
    return as_text(rows.select("conv_id", "turn", add_special_pair("a", "b", SP).alias("input_ids")), "input_ids")


DECODED = f"""{q.tokens('documents', 'doc_id')}, {q.vocab()},
    dec AS (SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE t END, ' ' ORDER BY pos) AS text,
                   string_agg(t, ' ' ORDER BY pos) AS want, count(*) AS n, count(*) - count(id) AS unknown
            FROM tok LEFT JOIN vocab USING (t) GROUP BY doc_id)"""


@query(
    "decode_words",
    f"WITH {DECODED} SELECT doc_id, coalesce(dec.text, '') AS text FROM documents LEFT JOIN dec USING (doc_id)",
)
def _decode_words(spark, d):
    tok = document_tokenizer(spark, d)
    ids = encode(documents(spark, d), "text", tok, attention_mask=False, keep_source=("doc_id",))
    return decode(ids, "input_ids", tok).select("doc_id", "text")


@query(
    "roundtrip",
    f"""WITH {DECODED} SELECT count(*) AS rows, count(*) FILTER (dec.text <> want) AS mismatched_rows,
        sum(n)::BIGINT AS tokens, sum(unknown)::BIGINT AS unknown_tokens, round(sum(unknown) / sum(n)::DOUBLE, 6) AS unknown_rate,
        round(sum(n) / sum(length(documents.text))::DOUBLE, 6) AS tokens_per_char
        FROM documents LEFT JOIN dec USING (doc_id)""",
)
def _roundtrip(spark, d):
    return roundtrip_report(documents(spark, d), "text", document_tokenizer(spark, d))


@query(
    "overlength",
    f"""WITH {DOCS} SELECT count(*) AS rows, count(*) FILTER (len(ids) > 512) AS over_limit,
        max(len(ids))::INT AS longest FROM enc""",
)
def _overlength(spark, d):
    return overlength_report(encoded_documents(spark, d, attention_mask=False), 512)


# --- vocabularies ---------------------------------------------------------------------------------

WORD_COUNTS = f"WITH {q.tokens('documents', 'doc_id')}, counts AS (SELECT t, count(*) AS n FROM tok GROUP BY t)"


@query("bpe_word_counts", f"{WORD_COUNTS} SELECT t AS token, n FROM counts")
def _bpe_word_counts(spark, d):
    return bpe.bpe_word_counts(documents(spark, d), "text")


def pair_counts_sql(source: str, key: str, name: str) -> str:
    return f"""{q.tokens(source, key, f'tok_{name}')},
    {name} AS (
      SELECT substr(t, i, 1) AS l, substr(t, i + 1, 1) AS r, sum(n)::BIGINT AS n
      FROM (SELECT t, n, unnest(range(1, length(t))) AS i
            FROM (SELECT t, count(*) AS n FROM tok_{name} GROUP BY t))
      GROUP BY 1, 2)"""


@query(
    "bpe_pair_counts",
    f"WITH {pair_counts_sql('documents', 'doc_id', 'dp')} SELECT l AS \"left\", r AS \"right\", n FROM dp",
)
def _bpe_pair_counts(spark, d):
    return bpe.bpe_pair_counts(bpe.symbol_table(bpe.bpe_word_counts(documents(spark, d), "text")))


@query("train_bpe")
def _train_bpe(spark, d):
    _, merges = bpe.train_bpe(documents(spark, d), "text", max_merges=32)
    return merges


TWO_VOCABS = f"""WITH {q.tokens('documents', 'doc_id')}, {q.vocab()},
    {q.tokens('conversations', 'conv_id', 'ctok')}, {q.vocab('ctok', 'cvocab')},
    merged AS (
      SELECT t, id FROM vocab UNION ALL
      SELECT t, ((SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY id))::INT AS id
      FROM cvocab WHERE t NOT IN (SELECT t FROM vocab))"""


def two_vocabs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = vocabulary.word_vocab(documents(spark, d), "text", VOCAB_SIZE)
    return base, vocabulary.word_vocab(conversations(spark, d), "text", VOCAB_SIZE)


@query("merge_vocab", f"{TWO_VOCABS} SELECT t AS token, id FROM merged")
def _merge_vocab(spark, d):
    return vocabulary.merge_vocab(*two_vocabs(spark, d))


def ranked_pairs(df: DataFrame) -> DataFrame:
    counts = cut_lineage(bpe.bpe_pair_counts(bpe.symbol_table(bpe.bpe_word_counts(df, "text"))), "pairs")
    return with_row_index(counts, [-F.col("n"), "left", "right"], "rank").select("rank", "left", "right")


@query(
    "merge_merges",
    f"""WITH {pair_counts_sql('documents', 'doc_id', 'dp')}, {pair_counts_sql('conversations', 'conv_id', 'cp')}
    SELECT row_number() OVER (ORDER BY n DESC, l, r) - 1 AS rank, l AS "left", r AS "right" FROM dp UNION ALL
    SELECT (SELECT count(*) FROM dp) + row_number() OVER (ORDER BY n DESC, l, r) - 1 AS rank, l, r FROM cp""",
)
def _merge_merges(spark, d):
    return vocabulary.merge_merges(ranked_pairs(documents(spark, d)), ranked_pairs(conversations(spark, d)))


@query(
    "vocab_report",
    f"""{TWO_VOCABS} SELECT old_size, new_size, new_size - old_size AS added FROM (
        SELECT (SELECT count(*) FROM vocab) AS old_size, (SELECT count(*) FROM merged) AS new_size)""",
)
def _vocab_report(spark, d):
    base, extra = two_vocabs(spark, d)
    return vocabulary.vocab_report(base, vocabulary.merge_vocab(base, extra))


# --- packing --------------------------------------------------------------------------------------


@query(
    "pack_clm",
    f"""WITH {DOCS}, {q.packed('ids', BLOCK, 1000, True)}
    SELECT batch_id, block_id, {q.text_of('ids')} AS input_ids, {q.text_of('ids')} AS labels FROM blk""",
)
def _pack_clm(spark, d):
    ids = indexed_ids(spark, d, 1000, attention_mask=False)
    return as_text(pack(ids, BLOCK, within=("rng",)).drop("rng"), "input_ids", "labels")


@query(
    "pack_strict",
    f"""WITH {DOCS}, {q.packed('ids', 4096, 16, False)}
    SELECT batch_id, block_id, {q.text_of('ids')} AS input_ids, {q.text_of('ids')} AS labels FROM blk""",
)
def _pack_strict(spark, d):
    ids = indexed_ids(spark, d, 16, attention_mask=False)
    blocks = pack(ids, 4096, batch_rows=16, keep_short=False, within=("rng",))
    return as_text(blocks.drop("rng"), "input_ids", "labels")


@query(
    "pack_mlm",
    f"""WITH {DOCS}, {q.packed(SPECIAL, 4096, 16, True)}
    SELECT batch_id, block_id, {q.text_of('ids')} AS input_ids,
      {q.text_of('list_transform(ids, lambda x: (x IN (1, 2))::INT)')} AS special_tokens_mask FROM blk""",
)
def _pack_mlm(spark, d):
    ids = indexed_ids(spark, d, 16, special=True, special_mask=True, attention_mask=False)
    blocks = pack(ids, 4096, batch_rows=16, labels=False, within=("rng",))
    return as_text(blocks.drop("rng"), "input_ids", "special_tokens_mask")


TRUNCATED = f"list_concat({q.cut('ids', 255)}, [4, 1])"


@query("truncate_rows", f"WITH {DOCS} SELECT doc_id, {q.text_of(TRUNCATED)} AS input_ids FROM enc")
def _truncate_rows(spark, d):
    rows = truncate_rows(documents(spark, d), "text", 256, document_tokenizer(spark, d), keep_source=("doc_id",))
    return as_text(rows, "input_ids")


LINE_KEY = "doc_id * 1000000 + line_no"
LINE_ROWS = f"""{LINES}, keyed AS (SELECT doc_id, line_no, {LINE_KEY} AS k, line FROM lines WHERE NOT {BLANK}),
    {q.tokens('documents', 'doc_id')}, {q.vocab()}, {q.tokens('keyed', 'k', 'ltok', 'line')},
    {q.encoded('keyed', 'k', 'ltok', name='lenc')},
    lrow AS (SELECT k, list_concat(list_concat([1], {q.cut('ids', 62)}), [2]) AS ids FROM lenc)"""


def lines_for_mlm(spark: SparkSession, d: str, pad_to_max: bool) -> DataFrame:
    keyed = document_lines(spark, d).select("doc_id", "line_no", "line")
    tok = document_tokenizer(spark, d)
    return line_rows(keyed, "line", 64, tok, pad_to_max, keep_source=("doc_id", "line_no"))


@query(
    "line_rows",
    f"""WITH {LINE_ROWS} SELECT doc_id, line_no, {q.text_of(q.pad('ids', 64, 0))} AS input_ids,
      {q.text_of(q.pad(q.repeat(1, 'len(ids)'), 64, 0))} AS attention_mask,
      {q.text_of(f"list_transform({q.pad('ids', 64, 0)}, lambda x: (x IN (0, 1, 2))::INT)")} AS special_tokens_mask
    FROM lrow JOIN keyed USING (k)""",
)
def _line_rows(spark, d):
    rows = lines_for_mlm(spark, d, pad_to_max=True)
    return as_text(rows, "input_ids", "attention_mask", "special_tokens_mask").withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


# --- instruction rows -----------------------------------------------------------------------------

IGNORED_SOURCE = q.repeat(-100, "len(x)")
ALPACA_SIDES = f"WITH {q.PAIRS}, " + q.sides(
    "pairs", f"concat({q.quoted(ALPACA_PREFIX)}, prompt, {q.quoted(ALPACA_SUFFIX)})", "response"
)
HISTORY_SIDES = f"WITH {q.HISTORY}, " + q.sides("hist", RENDERED, "response")
CUSTOM_SIDES = f"WITH {q.HISTORY}, " + q.sides("hist", CUSTOM, "response")
HIDE_PAD = "list_transform({}, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END)"


def _rows_sql(sides: str, x: str, y: str, ids: str, labels: str) -> str:
    """``x`` and ``y`` are the finished halves; ids and labels are written over them."""
    return f"""{sides} SELECT conv_id, turn, {q.text_of(ids)} AS input_ids, {q.text_of(labels)} AS labels
    FROM (SELECT conv_id, turn, {x} AS x, {y} AS y FROM s)"""


TOTAL = SOURCE + TARGET


def too_long(source: int, target: int) -> str:
    return f"len(a) + len(b) > {source + target - 2}"


TOO_LONG = too_long(SOURCE, TARGET)


def alpaca_rows(spark: SparkSession, d: str) -> DataFrame:
    return apply_template(pairs(spark, d), "standard_alpaca", keep_source=("conv_id", "turn"))


def llama_rows(spark: SparkSession, d: str, source: int = SOURCE, target: int = TARGET) -> DataFrame:
    rows, tok = alpaca_rows(spark, d), conversation_tokenizer(spark, d)
    return instruct.sft_llama(rows, source, target, tok, keep_source=("conv_id", "turn"))


def _half_sql(side: str, length: int) -> str:
    return q.pad(f"list_concat(list_concat([1], {q.cut(side, length - 2)}), [2])", length, 0)


def _sft_queries(suffix: str, source: int, target: int) -> None:
    """The four layouts for one budget: the usual one, and one that cuts both sides."""
    total, keep = source + target, ("conv_id", "turn")
    cut_if = lambda side, n: f"CASE WHEN {too_long(source, target)} THEN {q.cut(side, n)} ELSE {side} END"

    @query(
        "sft_llama" + suffix,
        _rows_sql(
            ALPACA_SIDES,
            f"list_concat([1], {cut_if('a', source - 1)})",
            f"list_concat({cut_if('b', target - 1)}, [2])",
            q.pad("list_concat(x, y)", total, 0),
            q.pad(f"list_concat({IGNORED_SOURCE}, y)", total, -100),
        ),
    )
    def _sft_llama(spark, d):
        return as_text(llama_rows(spark, d, source, target), "input_ids", "labels")

    @query(
        "sft_halves" + suffix,
        _rows_sql(
            ALPACA_SIDES,
            _half_sql("a", source - 1),
            _half_sql("b", target - 1),
            "list_concat(x, y)",
            f"list_concat({IGNORED_SOURCE}, y)",
        ),
    )
    def _sft_halves(spark, d):
        rows, tok = alpaca_rows(spark, d), conversation_tokenizer(spark, d)
        return as_text(instruct.sft_halves(rows, source, target, tok, keep_source=keep), "input_ids", "labels")

    @query(
        "sft_bos" + suffix,
        _rows_sql(
            HISTORY_SIDES,
            f"list_concat({q.cut('a', source - 1)}, [4])",
            f"list_concat(list_concat([1], {q.cut('b', target - 2)}), [2])",
            q.pad("list_concat(x, y)", total, 0),
            HIDE_PAD.format(q.pad(f"list_concat({IGNORED_SOURCE}, y)", total, 0)),
        ),
    )
    def _sft_bos(spark, d):
        tok = conversation_tokenizer(spark, d)
        rows = instructions(spark, d, source, tok)
        return as_text(instruct.sft_bos(rows, source, target, tok, keep_source=keep), "input_ids", "labels")

    @query(
        "sft_prefix" + suffix,
        _rows_sql(
            CUSTOM_SIDES,
            f"list_concat({q.cut('a', source - 2)}, [4, 1])",
            f"list_concat({q.cut('b', target)}, [2])",
            q.pad("list_concat(x, y)", total, 0),
            HIDE_PAD.format(q.pad(f"list_concat({q.repeat(0, 'len(x)')}, y)", total, 0)),
        ),
    )
    def _sft_prefix(spark, d):
        tok = conversation_tokenizer(spark, d)
        form = dict(turn_format=CUSTOM_FORMAT, separator="\n\n", first=1)
        rows = instructions(spark, d, source, tok, **form)
        return as_text(instruct.sft_prefix(rows, source, target, tok, keep_source=keep, **form), "input_ids", "labels")


for _suffix, _budget in BUDGETS.items():
    _sft_queries(_suffix, *_budget)


SHARE = "CASE WHEN la + lb = 0 THEN 0 ELSE trunc(32 * (la * 1.0::DOUBLE / (la + lb)))::INT END"


@query(
    "prop_budget",
    f"""{PAIR_SIDES}, n AS (SELECT conv_id, turn, len(a)::INT AS la, len(b)::INT AS lb, {SHARE} AS s0
          FROM (SELECT *, len(a)::INT AS la, len(b)::INT AS lb FROM s)),
    m AS (SELECT *, CASE WHEN s0 <= 0 THEN la ELSE s0 END AS s1, CASE WHEN s0 <= 0 THEN 32 - la ELSE 32 - s0 END AS t1 FROM n)
    SELECT conv_id, turn, (CASE WHEN t1 <= 0 THEN 32 - lb ELSE s1 END)::INT AS source_budget,
           (CASE WHEN t1 <= 0 THEN lb ELSE t1 END)::INT AS target_budget FROM m""",
)
def _prop_budget(spark, d):
    source, target = proportional_budget(F.size("a"), F.size("b"), 32)
    return pair_ids(spark, d).select("conv_id", "turn", source.alias("source_budget"), target.alias("target_budget"))


@query(
    "mask_pad",
    f"""{PAIR_SIDES} SELECT conv_id, turn, {q.text_of(HIDE_PAD.format(q.pad('b', 48, 0)))} AS labels FROM s""",
)
def _mask_pad(spark, d):
    padded = pair_ids(spark, d).withColumn("labels", pad_right("b", 48, SP.pad))
    return as_text(padded.select("conv_id", "turn", mask_pad("labels", SP.pad).alias("labels")), "labels")


BARE_SIDES = f"WITH {q.HISTORY}, " + q.sides(
    "hist", f"CASE WHEN len(history) = 0 THEN prompt ELSE {RENDERED} END", "response"
)


@query(
    "seq2seq_rows",
    f"""{BARE_SIDES}, x AS (SELECT row_idx, row_idx // 16 AS batch_id,
          list_concat({q.cut('a', SOURCE - 2)}, [4, 1]) AS x, list_concat({q.cut('b', TARGET - 2)}, [4, 1]) AS y FROM s),
    w AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS longest FROM x)
    SELECT row_idx, batch_id, {q.text_of(q.pad('x', 'longest', 0))} AS input_ids,
           {q.text_of(q.pad(q.repeat(1, 'len(x)'), 'longest', 0))} AS attention_mask, {q.text_of('y')} AS labels FROM w""",
)
def _seq2seq_rows(spark, d):
    tok = conversation_tokenizer(spark, d)
    rows = cut_lineage(instructions(spark, d, SOURCE, tok), "instructions")
    rows = with_row_index(rows, ["conv_id", "turn"], align=16, range_col="rng")
    built = instruct.seq2seq_rows(rows, SOURCE, TARGET, tok, batch_rows=16, within=("rng",)).drop("rng")
    return as_text(built, "input_ids", "attention_mask", "labels")


@query(
    "check_sequences",
    f"""WITH {q.PAIRS} SELECT count(*) AS rows, count(*) FILTER (turn % 3 = 0 AND conv_id % 5 != 0) AS unequal,
      count(*) FILTER (conv_id % 5 = 0) AS wrong_length FROM pairs""",
)
def _check_sequences(spark, d):
    """Rows of which some are broken on purpose: labels one short, or both lists two short."""
    shorter = lambda c, n: F.slice(c, F.lit(1), F.size(c) - n)
    rows = llama_rows(spark, d)
    both = F.col("conv_id") % 5 == 0
    broken = rows.withColumns(
        {
            "input_ids": F.when(both, shorter("input_ids", 2)).otherwise(F.col("input_ids")),
            "labels": F.when(both, shorter("labels", 2)).when(F.col("turn") % 3 == 0, shorter("labels", 1)).otherwise(F.col("labels")),
        }
    )
    return instruct.check_sequences(broken, TOTAL)


# --- mini-batches ---------------------------------------------------------------------------------


def _collated_sql(cte: str, ids: str, source: str, key: str, multiple: int | None, columns: str) -> str:
    longest = "max(len(ids)) OVER (PARTITION BY row_idx // 8)"
    if multiple:
        longest = f"(({longest}) + {multiple - 1}) // {multiple} * {multiple}"
    return f"""WITH {cte}, i AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS row_idx, {ids} AS ids FROM {source}),
    p AS (SELECT row_idx, row_idx // 8 AS mini_batch_id, ids, {longest} AS longest FROM i)
    SELECT row_idx, mini_batch_id, {columns} FROM p"""


PADDED = q.pad("ids", "longest", 0)


@query(
    "collate_clm",
    _collated_sql(
        DOCS, TRUNCATED, "enc", "doc_id", None,
        f"{q.text_of(PADDED)} AS input_ids, {q.text_of(HIDE_PAD.format(PADDED))} AS labels",
    ),
)
def _collate_clm(spark, d):
    rows = truncate_rows(documents(spark, d), "text", 256, document_tokenizer(spark, d), keep_source=("doc_id",))
    indexed = with_row_index(rows, "doc_id", align=8, range_col="rng")
    batches = collate.collate(indexed, "causal", 8, SP, within=("rng",))
    return as_text(batches.select("row_idx", "mini_batch_id", "input_ids", "labels"), "input_ids", "labels")


@query(
    "collate_mult8",
    _collated_sql(
        LINE_ROWS, "ids", "lrow", "k", 8,
        f"""{q.text_of(PADDED)} AS input_ids, {q.text_of(HIDE_PAD.format(PADDED))} AS labels,
        {q.text_of(q.pad(q.repeat(1, 'len(ids)'), 'longest', 0))} AS attention_mask""",
    ),
)
def _collate_mult8(spark, d):
    rows = cut_lineage(lines_for_mlm(spark, d, pad_to_max=False).drop("special_tokens_mask"), "lines")
    indexed = with_row_index(rows, ["doc_id", "line_no"], align=8, range_col="rng")
    batches = collate.collate_clm(indexed, 8, SP, multiple_of=8, within=("rng",))
    out = batches.select("row_idx", "mini_batch_id", "input_ids", "labels", "attention_mask")
    return as_text(out, "input_ids", "labels", "attention_mask")


DRAWN = f"""{DOCS}, z AS (SELECT doc_id, {SPECIAL} AS ids FROM enc),
    t AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM z),
    h AS (SELECT *, md5(concat_ws('-', doc_id, i, {SEED})) AS h FROM t),
    c AS (SELECT *, x NOT IN (1, 2) AND {q.draw('h', 1)} / 4294967296.0::DOUBLE < 0.15 AS chosen,
                 {q.draw('h', 9)} / 4294967296.0::DOUBLE AS kind FROM h),
    m AS (SELECT doc_id, i, x, CASE WHEN NOT chosen THEN x WHEN kind < 0.8 THEN 4
                   WHEN kind < 0.9 THEN ({q.draw('h', 17)} % {IDS_END})::INT ELSE x END AS hidden,
                 CASE WHEN chosen THEN x ELSE -100 END AS label, h FROM c)"""


def _masked_sql(multiple: int | None) -> str:
    longest = "max(len(ids)) OVER (PARTITION BY row_idx // 8)"
    if multiple:
        longest = f"(({longest}) + {multiple - 1}) // {multiple} * {multiple}"
    return f"""WITH {LINE_ROWS}, i AS (SELECT row_number() OVER (ORDER BY k) - 1 AS row_idx, ids FROM lrow),
    p AS (SELECT row_idx, ids, {longest} AS longest FROM i),
    z AS (SELECT row_idx, {PADDED} AS ids FROM p),
    t AS (SELECT row_idx, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM z),
    h AS (SELECT *, md5(concat_ws('-', row_idx, i, {SEED})) AS h FROM t),
    c AS (SELECT *, x NOT IN (0, 1, 2) AND {q.draw('h', 1)} / 4294967296.0::DOUBLE < 0.15 AS chosen,
                 {q.draw('h', 9)} / 4294967296.0::DOUBLE AS kind FROM h)
    SELECT row_idx, row_idx // 8 AS mini_batch_id,
      string_agg((CASE WHEN NOT chosen THEN x WHEN kind < 0.8 THEN 4 WHEN kind < 0.9 THEN ({q.draw('h', 17)} % {IDS_END})::INT
                  ELSE x END)::VARCHAR, ' ' ORDER BY i) AS input_ids,
      string_agg((CASE WHEN chosen THEN x ELSE -100 END)::VARCHAR, ' ' ORDER BY i) AS labels,
      string_agg((i < n)::INT::VARCHAR, ' ' ORDER BY i) AS attention_mask
    FROM c JOIN (SELECT row_idx, len(ids) AS n FROM i) USING (row_idx) GROUP BY row_idx"""


def masked_batches(spark: SparkSession, d: str, multiple_of: int | None) -> DataFrame:
    rows = lines_for_mlm(spark, d, pad_to_max=False).drop("attention_mask", "special_tokens_mask")
    indexed = with_row_index(cut_lineage(rows, "lines"), ["doc_id", "line_no"], align=8, range_col="rng")
    masks = with_masks(indexed, SP, special_mask=True)
    batches = collate.collate(masks, "masked", 8, SP, IDS_END, seed=SEED, multiple_of=multiple_of, within=("rng",))
    out = batches.select("row_idx", "mini_batch_id", "input_ids", "labels", "attention_mask")
    return as_text(out, "input_ids", "labels", "attention_mask")


@query("collate_mlm", _masked_sql(None))
def _collate_mlm(spark, d):
    return masked_batches(spark, d, None)


@query("collate_mlm8", _masked_sql(8))
def _collate_mlm8(spark, d):
    return masked_batches(spark, d, 8)


def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    ids = encoded_documents(spark, d, special=True, special_mask=True, attention_mask=False)
    return collate.mask_tokens(ids, SP, IDS_END, seed=SEED, key="doc_id")


@query(
    "mask_tokens",
    f"""WITH {DRAWN} SELECT doc_id, string_agg(hidden::VARCHAR, ' ' ORDER BY i) AS input_ids,
        string_agg(label::VARCHAR, ' ' ORDER BY i) AS labels FROM m GROUP BY doc_id""",
)
def _mask_tokens(spark, d):
    return as_text(masked_documents(spark, d).select("doc_id", "input_ids", "labels"), "input_ids", "labels")


@query(
    "collate_fixed",
    f"""{ALPACA_SIDES}, x AS (SELECT row_idx,
          list_concat([1], CASE WHEN {TOO_LONG} THEN {q.cut('a', SOURCE - 1)} ELSE a END) AS x,
          list_concat(CASE WHEN {TOO_LONG} THEN {q.cut('b', TARGET - 1)} ELSE b END, [2]) AS y FROM s)
    SELECT row_idx // 8 AS mini_batch_id,
      string_agg({q.text_of(q.pad('list_concat(x, y)', TOTAL, 0))}, '|' ORDER BY row_idx) AS input_ids,
      string_agg({q.text_of(q.pad(f'list_concat({IGNORED_SOURCE}, y)', TOTAL, -100))}, '|' ORDER BY row_idx) AS labels
    FROM x GROUP BY 1""",
)
def _collate_fixed(spark, d):
    rows = cut_lineage(llama_rows(spark, d), "rows")
    rows = with_row_index(rows, ["conv_id", "turn"], align=8, range_col="rng")
    stacked = collate.collate(rows, "fixed", 8, within=("rng",)).drop("rng")
    rows_text = {c: F.array_join(F.transform(c, join_ids), "|") for c in ("input_ids", "labels")}
    return stacked.withColumns(rows_text)


@query(
    "shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('-', doc_id, {SEED})), doc_id) - 1 AS row_idx FROM documents",
)
def _shuffle(spark, d):
    return shuffle(documents(spark, d).select("doc_id"), SEED, "doc_id")


# --- evaluation -----------------------------------------------------------------------------------


def logit_rows(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as the logits of one position each, the label as its target."""
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.array(F.col("embedding").cast("array<double>")).alias("logits"),
        F.array(F.col("label").cast("int")).alias("labels"),
    )


LOGITS = "l AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
NLL = f"""{LOGITS}, e AS (SELECT vec_id, label,
      ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label + 1] AS nll FROM l)"""


@query(
    "argmax",
    f"WITH {LOGITS} SELECT vec_id, (list_position(v, list_max(v)) - 1)::VARCHAR AS preds, label::VARCHAR AS labels FROM l",
)
def _argmax(spark, d):
    return as_text(evaluate.predictions(logit_rows(spark, d)).select("vec_id", "preds", "labels"), "preds", "labels")


def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    """Masked documents with made-up predictions: the right id in about 70 % of the places."""
    rows = masked_documents(spark, d)
    truth = F.zip_with("input_ids", "labels", lambda x, y: F.when(y == -100, x).otherwise(y))
    guess = F.transform(truth, lambda x, i: F.when((x * 7 + i * 3) % 10 < 7, x).otherwise(x + 1))
    return rows.withColumn("preds", guess)


JUDGED = f"""{DRAWN}, j AS (SELECT doc_id, i, label,
      CASE WHEN (x * 7 + i * 3) % 10 < 7 THEN x ELSE x + 1 END AS pred FROM m)"""


def _accuracy(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "acc_shifted",
    f"""WITH {JUDGED} SELECT sum((p = label)::INT)::BIGINT AS correct, count(*) AS total,
        round(sum((p = label)::INT) / count(*)::DOUBLE, 9) AS accuracy
    FROM (SELECT label, lag(pred) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM j) WHERE p IS NOT NULL""",
)
def _acc_shifted(spark, d):
    return _accuracy(evaluate.token_accuracy(judged_documents(spark, d)))


@query(
    "acc_masked",
    f"""WITH {JUDGED} SELECT sum((pred = label)::INT)::BIGINT AS correct, count(*) AS total,
        round(sum((pred = label)::INT) / count(*)::DOUBLE, 9) AS accuracy FROM j WHERE label <> -100""",
)
def _acc_masked(spark, d):
    return _accuracy(evaluate.token_accuracy(judged_documents(spark, d), shift=False, ignore=-100))


def losses_by_label(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.token_losses(logit_rows(spark, d)).withColumn("label", F.col("labels")[0])


@query(
    "perplexity",
    f"""WITH {NLL} SELECT label, count(*) AS tokens, round(avg(nll), 6) AS eval_loss, round(exp(avg(nll)), 6) AS perplexity
    FROM e GROUP BY label""",
)
def _perplexity(spark, d):
    out = evaluate.perplexity(losses_by_label(spark, d), ["label"])
    return out.withColumns({c: F.round(c, 6) for c in ("eval_loss", "perplexity")})


@query("mean_nll", f"WITH {NLL} SELECT count(*) AS tokens, round(avg(nll), 6) AS eval_loss FROM e")
def _mean_nll(spark, d):
    return evaluate.mean_nll(losses_by_label(spark, d)).withColumn("eval_loss", F.round("eval_loss", 6))


@query(
    "sample_counts",
    f"WITH {SPLIT} SELECT split, CASE WHEN split = 'train' THEN least(count(*), 500) ELSE count(*) END AS samples FROM sp GROUP BY split",
)
def _sample_counts(spark, d):
    split = split_percent(documents(spark, d).select("doc_id"), 5, "doc_id")
    return sample_counts(split, {"train": 500, "validation": None})


# --- prediction -----------------------------------------------------------------------------------

ADAPTERS = "user, /adapters/old, assistant ,/adapters/a,, system,/adapters/s,user,/adapters/u"
PATHS = "CASE role WHEN 'user' THEN '/adapters/u' WHEN 'assistant' THEN '/adapters/a' ELSE '/adapters/s' END"


def routed(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations(spark, d).select("conv_id", "turn", F.col("role").alias("adapter_name"), F.col("text").alias("input"))
    return predict.route(rows, ADAPTERS)


@query(
    "route_adapters",
    f"SELECT conv_id, turn, role AS adapter_name, text AS input, {PATHS} AS adapter_path FROM conversations",
)
def _route_adapters(spark, d):
    return routed(spark, d)


def echo_scorer(adapter: str | None, path: str | None):
    """A stand-in for a model: repeats the prompt and adds the adapter path and the prompt length."""

    def score(prompts: list[str]) -> list[str]:
        return [f"{p} {path} saw {len(p)}\nEND </s>" for p in prompts]

    return score


CHAT_LENGTH = len(CHAT_PREFIX) + len(CHAT_SUFFIX)


@query(
    "predict_echo",
    f"""SELECT conv_id, turn, role AS adapter_name, text AS input,
      concat({PATHS}, ' saw ', length(text) + {CHAT_LENGTH}, ' ') AS target FROM conversations""",
)
def _predict_echo(spark, d):
    out = predict.predict(
        routed(spark, d), echo_scorer, template("chat_prompt")(F.col("input")), adapter="adapter_name"
    )
    target = predict.clean_answer("out_text", "prompt_text").alias("target")
    return out.select("conv_id", "turn", "adapter_name", "input", target)


GENERATED_SQL = "concat(prompt, ' ', response, chr(10), 'END', prompt, chr(12288), '</s>', chr(9))"
CLEANED = (
    f"regexp_replace(replace(replace({GENERATED_SQL}, prompt, ''), chr(10) || 'END', ''), "
    f"'^{q.SPACE_SQL}+|{q.SPACE_SQL}+$', '', 'g')"
)


@query(
    "clean_answer",
    f"""WITH {q.PAIRS} SELECT conv_id, turn,
      CASE WHEN ends_with(c, '</s>') THEN left(c, length(c) - 4) ELSE c END AS target
    FROM (SELECT conv_id, turn, {CLEANED} AS c FROM pairs)""",
)
def _clean_answer(spark, d):
    generated = F.concat(
        "prompt", F.lit(" "), "response", F.lit("\nEND"), "prompt", F.lit("　</s>\t")
    )
    return pairs(spark, d).select("conv_id", "turn", predict.clean_answer(generated, "prompt").alias("target"))


# --- streams --------------------------------------------------------------------------------------


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    present = table(spark, d, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory():
        stream = read_stream(spark, f"{d}/{name}.parquet", "parquet", present.schema)
    else:
        stream = read_stream(spark, d, "parquet", present.schema, pathGlobFilter=f"{name}.parquet")
    return stream.repartition(spark.sparkContext.defaultParallelism) if is_small(present) else stream


@query("stream_read", "SELECT doc_id, text, lang FROM documents")
def _stream_read(spark, d):
    docs = streamed(spark, d, "documents").select("doc_id", "text", "lang")
    return run_available(docs, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))


@query(
    "stream_sft",
    f"""WITH {q.tokens('conversations', 'conv_id', 'ctok')}, {q.vocab('ctok')},
    src AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS row_idx, conv_id, turn,
              concat({q.quoted(ZIYA_PREFIX)}, text, {q.quoted(ZIYA_SUFFIX)}) AS text_a, text AS text_b FROM conversations),
    {q.tokens('src', 'row_idx', 'tok_a', 'text_a')}, {q.tokens('src', 'row_idx', 'tok_b', 'text_b')},
    {q.encoded('src', 'row_idx', 'tok_a', name='enc_a')}, {q.encoded('src', 'row_idx', 'tok_b', name='enc_b')},
    s AS (SELECT conv_id, turn, enc_a.ids AS a, enc_b.ids AS b FROM src JOIN enc_a USING (row_idx) JOIN enc_b USING (row_idx))
    """
    + _rows_sql(
        "",
        f"list_concat([1], CASE WHEN {TOO_LONG} THEN {q.cut('a', SOURCE - 1)} ELSE a END)",
        f"list_concat(CASE WHEN {TOO_LONG} THEN {q.cut('b', TARGET - 1)} ELSE b END, [2])",
        q.pad("list_concat(x, y)", TOTAL, 0),
        q.pad(f"list_concat({IGNORED_SOURCE}, y)", TOTAL, -100),
    ),
)
def _stream_sft(spark, d):
    # Every turn is its own answer here: pairing turns needs their order, which a stream lacks.
    turns = streamed(spark, d, "conversations")
    rows = apply_template(turns, "ziya_prompt", "text", "text", keep_source=("conv_id", "turn"))
    built = instruct.sft_llama(rows, SOURCE, TARGET, conversation_tokenizer(spark, d), keep_source=("conv_id", "turn"))
    out = run_available(built, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))
    return as_text(out, "input_ids", "labels")


@query(
    "stream_pack",
    f"""WITH {DOCS}, {q.packed('ids', BLOCK, 1000, True)}
    SELECT batch_id, block_id, {q.text_of('ids')} AS input_ids, {q.text_of('ids')} AS labels FROM blk""",
)
def _stream_pack(spark, d):
    ids = encode(
        streamed(spark, d, "documents"), "text", document_tokenizer(spark, d), attention_mask=False, keep_source=("doc_id",)
    )
    path = scratch_path(spark, "stream")
    pack_stream(ids, BLOCK, "doc_id", path, scratch_path(spark, "stream-state"), columns=["input_ids"]).awaitTermination()
    return as_text(spark.read.parquet(path).drop("micro_batch"), "input_ids", "labels")
