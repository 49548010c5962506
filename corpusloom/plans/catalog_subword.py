"""Queries of the subword tokenizers; their SQL walks the words sign by sign in recursive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.sequences import Specials
from corpusloom.functions.text import join_ids, words
from corpusloom.operators import subword
from corpusloom.operators.order import with_row_index
from corpusloom.operators.pack import pack
from corpusloom.operators.tokenize import decode, encode
from corpusloom.plans import sql_parts as q
from corpusloom.plans.catalog import SPECIAL, as_text, documents
from corpusloom.plans.registry import query
from corpusloom.session import cut_lineage

PIECES, FIRST = 4_000, Specials().first_free
SHORT, LONG = 4, 6  # signs of the candidates of the two vocabularies


def best_pieces(counts: DataFrame, size: int = PIECES) -> DataFrame:
    """``(token, id, n)`` of the most frequent candidates."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return cut_lineage(top.select("token", (rank - 1 + FIRST).cast("int").alias("id"), "n"), "pieces")


def longest_match(spark, d) -> subword.LongestMatchTokenizer:
    return subword.LongestMatchTokenizer(best_pieces(subword.piece_counts(documents(spark, d), "text", words, SHORT, subword.CONTINUED)))


def by_scores(spark, d) -> subword.ScoreTokenizer:
    """Scores are thousandths of the logarithm of a piece's share, in whole numbers, so sums are exact."""
    pieces = best_pieces(subword.piece_counts(documents(spark, d), "text", subword.marked_words, LONG))
    total = pieces.agg(F.sum("n")).first()[0] or 1
    score = F.round(1000 * F.log(F.col("n") / F.lit(float(total)))).cast("bigint")
    return subword.ScoreTokenizer(pieces.select("token", "id", score.alias("score")))


def _pieces_sql(longest: int, sign: str) -> str:
    return f"""counts AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
    spans AS (SELECT t, n, i, unnest(range(1, least({longest}, length(t) - i + 1) + 1)) AS k
      FROM (SELECT t, n, unnest(range(1, length(t) + 1)) AS i FROM counts)),
    cand AS (SELECT CASE WHEN i > 1 THEN '{sign}' ELSE '' END || substr(t, i, k) AS token, n FROM spans
      UNION ALL SELECT t, n FROM counts WHERE length(t) > {longest}),
    voc AS MATERIALIZED (SELECT token, ({FIRST - 1} + row_number() OVER (ORDER BY n DESC, token))::INT AS id, n
      FROM (SELECT token, sum(n)::BIGINT AS n FROM cand GROUP BY token) ORDER BY n DESC, token LIMIT {PIECES})"""


GREEDY = f"""WITH RECURSIVE {q.tokens('documents', 'doc_id')}, {_pieces_sql(SHORT, subword.CONTINUED)},
    reach AS MATERIALIZED (SELECT t, i, arg_max(j, j) AS j, arg_max(voc.id, j) AS id FROM (
        SELECT t, i, unnest(range(i + 1, length(t) + 1)) AS j FROM (SELECT t, unnest(range(0, length(t))) AS i FROM counts WHERE length(t) <= 100)) s
      JOIN voc ON voc.token = CASE WHEN i > 0 THEN '{subword.CONTINUED}' ELSE '' END || substr(t, i + 1, j - i) GROUP BY t, i),
    walk AS (SELECT t, 0::BIGINT AS upto, []::INT[] AS ids FROM counts
      UNION ALL SELECT w.t, r.j, list_append(w.ids, r.id) FROM walk w JOIN reach r ON r.t = w.t AND r.i = w.upto),
    cut AS MATERIALIZED (SELECT t, coalesce(any_value(ids) FILTER (upto = length(t) AND upto > 0), [3]) AS ids FROM walk GROUP BY t),
    enc AS (SELECT doc_id, coalesce(ids, []::INT[]) AS ids FROM documents LEFT JOIN (
      SELECT doc_id, flatten(list(cut.ids ORDER BY pos)) AS ids FROM tok JOIN cut USING (t) GROUP BY doc_id) USING (doc_id))"""

MARKED = f"""tok AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos
      FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: '{subword.MARK}' || w) AS l FROM documents))"""

LATTICE = f"""WITH RECURSIVE {MARKED}, {_pieces_sql(LONG, '')},
    scored AS MATERIALIZED (SELECT token, id, round(1000 * ln(n / (SELECT sum(n) FROM voc)::DOUBLE))::BIGINT AS score FROM voc),
    edges AS MATERIALIZED (SELECT t, i, j, coalesce(score, (SELECT min(score) FROM scored) - {subword.UNKNOWN_PENALTY}) AS score, coalesce(id, 3) AS id
      FROM (SELECT t, i, unnest(range(i + 1, least(length(t), i + (SELECT max(length(token)) FROM voc)) + 1)) AS j
        FROM (SELECT t, unnest(range(0, length(t))) AS i FROM counts)) s
      LEFT JOIN scored ON scored.token = substr(t, i + 1, j - i) WHERE id IS NOT NULL OR j = i + 1),
    best AS (SELECT t, 0::BIGINT AS j, [0::BIGINT] AS sums, [0::BIGINT] AS begins, [0] AS ids FROM counts
      UNION ALL
      SELECT t, j + 1, list_append(any_value(sums), max(total)), list_append(any_value(begins), arg_max(i, [total, -i])),
        list_append(any_value(ids), arg_max(id, [total, -i]))
      FROM (SELECT b.t, b.j, b.sums, b.begins, b.ids, e.i, e.id, b.sums[e.i + 1] + e.score AS total
        FROM best b JOIN edges e ON e.t = b.t AND e.j = b.j + 1)
      GROUP BY t, j),
    ends AS MATERIALIZED (SELECT t, begins, ids FROM best WHERE j = length(t)),
    back AS (SELECT t, length(t)::BIGINT AS upto, []::INT[] AS found FROM ends
      UNION ALL SELECT back.t, ends.begins[upto + 1], list_prepend(ends.ids[upto + 1], found) FROM back JOIN ends USING (t) WHERE upto > 0),
    cut AS MATERIALIZED (SELECT t, found AS ids FROM back WHERE upto = 0),
    enc AS (SELECT doc_id, coalesce(ids, []::INT[]) AS ids FROM documents LEFT JOIN (
      SELECT doc_id, flatten(list(cut.ids ORDER BY pos)) AS ids FROM tok JOIN cut USING (t) GROUP BY doc_id) USING (doc_id)),
    names AS (SELECT id, token FROM voc UNION ALL SELECT 3, '<unk>')"""


@query("piece_vocab", f"WITH {q.tokens('documents', 'doc_id')}, {_pieces_sql(SHORT, subword.CONTINUED)} SELECT token, id FROM voc")
def _piece_vocab(spark, d):
    return longest_match(spark, d).vocab


@query("encode_longest", f"{GREEDY} SELECT doc_id, {q.text_of('ids')} AS input_ids FROM enc")
def _encode_longest(spark, d):
    ids = encode(documents(spark, d), "text", longest_match(spark, d), attention_mask=False, keep_source=("doc_id",))
    return as_text(ids, "input_ids")


@query(
    "decode_longest",
    f"""{GREEDY} SELECT doc_id, coalesce(string_agg(CASE WHEN cut.ids = [3] THEN '<unk>' ELSE t END, ' ' ORDER BY pos), '') AS text
    FROM documents LEFT JOIN tok USING (doc_id) LEFT JOIN cut USING (t) GROUP BY doc_id""",
)
def _decode_longest(spark, d):
    tok = longest_match(spark, d)
    ids = encode(documents(spark, d), "text", tok, attention_mask=False, keep_source=("doc_id",))
    return decode(ids, "input_ids", tok).select("doc_id", "text")


@query(
    "longest_mlm",
    f"""{GREEDY}, {q.packed(SPECIAL, 512, 16, True)}
    SELECT batch_id, block_id, {q.text_of('ids')} AS input_ids,
      {q.text_of('list_transform(ids, lambda x: (x IN (1, 2))::INT)')} AS special_tokens_mask FROM blk""",
)
def _longest_mlm(spark, d):
    """Packed rows of the masked scripts on their kind of vocabulary."""
    options = dict(special=True, special_mask=True, attention_mask=False, keep_source=("doc_id",))
    ids = encode(documents(spark, d), "text", longest_match(spark, d), **options)
    indexed = with_row_index(ids, "doc_id", align=16, range_col="rng").drop("doc_id")
    blocks = pack(indexed, 512, batch_rows=16, labels=False, within=("rng",))
    return as_text(blocks.drop("rng"), "input_ids", "special_tokens_mask")


@query("encode_scores", f"{LATTICE} SELECT doc_id, {q.text_of('ids')} AS input_ids FROM enc")
def _encode_scores(spark, d):
    ids = encode(documents(spark, d), "text", by_scores(spark, d), attention_mask=False, keep_source=("doc_id",))
    return ids.select("doc_id", join_ids("input_ids").alias("input_ids"))


@query(
    "decode_scores",
    f"""{LATTICE} SELECT doc_id, coalesce(ltrim(replace((SELECT string_agg(names.token, '' ORDER BY k) FROM (
        SELECT unnest(enc.ids) AS id, generate_subscripts(enc.ids, 1) AS k) x JOIN names USING (id)), '{subword.MARK}', ' '), ' '), '') AS text FROM enc""",
)
def _decode_scores(spark, d):
    tok = by_scores(spark, d)
    ids = encode(documents(spark, d), "text", tok, attention_mask=False, keep_source=("doc_id",))
    return decode(ids, "input_ids", tok).select("doc_id", "text")
