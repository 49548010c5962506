"""Common pieces of the SQL twins. Ids: pad 0, bos 1, eos 2, unk 3, mask 4, words from 5."""

from __future__ import annotations

from corpusloom.functions.text import WORD_PATTERN

VOCAB_SIZE = 30_000
SPACE_SQL = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def tokens(source: str, key: str, name: str = "tok", text: str = "text") -> str:
    """CTE ``(key, pos, t)`` of the words of a table."""
    return f"""{name} AS (
      SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS pos
      FROM (SELECT {key}, regexp_extract_all(lower({text}), '{WORD_PATTERN}') AS l FROM {source}))"""


def vocab(tok: str = "tok", name: str = "vocab", size: int | None = VOCAB_SIZE) -> str:
    """CTE ``(t, id)``."""
    limit = "" if size is None else f" WHERE id < {5 + size}"
    return f"""{name} AS (SELECT * FROM (
      SELECT t, (4 + row_number() OVER (ORDER BY n DESC, t))::INT AS id
      FROM (SELECT t, count(*) AS n FROM {tok} GROUP BY t)){limit})"""


def encoded(source: str, key: str, tok: str = "tok", voc: str = "vocab", name: str = "enc") -> str:
    """CTE ``(key, ids)``; rows without words have an empty list."""
    return f"""{name} AS (
      SELECT {key}, coalesce(ids, []::INT[]) AS ids FROM {source} LEFT JOIN (
        SELECT {key}, list(coalesce(id, 3) ORDER BY pos) AS ids
        FROM {tok} LEFT JOIN {voc} USING (t) GROUP BY {key}) USING ({key}))"""


def docs_encoded(size: int | None = VOCAB_SIZE) -> str:
    return ",\n".join([tokens("documents", "doc_id"), vocab(size=size), encoded("documents", "doc_id")])


def text_of(ids: str) -> str:
    return f"coalesce(array_to_string({ids}, ' '), '')"


def cut(ids: str, n: str | int) -> str:
    return f"{ids}[1:greatest({n}, 0)]"


def repeat(value: int, n: str) -> str:
    return f"list_transform(range(0, greatest({n}, 0)::BIGINT), lambda r: {value})"


def pad(ids: str, n: str | int, value: int) -> str:
    return f"list_concat({ids}, {repeat(value, f'{n} - len({ids})')})"


PAIRS = """sp AS (
      SELECT conv_id, turn, role, text, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text
      FROM conversations WHERE role IN ('user', 'assistant')
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    pairs AS (
      SELECT conv_id, turn, before_text AS prompt, text AS response,
             row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx
      FROM sp WHERE role = 'assistant' AND before_role = 'user')"""

HISTORY = PAIRS + """,
    hist AS (
      SELECT *, coalesce(list([prompt, response]) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history
      FROM pairs)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sides(source: str, a: str, b: str) -> str:
    """CTE ``s (row_idx, conv_id, turn, a, b)``: both texts of a row encoded with the conversation vocabulary."""
    return ",\n".join(
        [
            tokens("conversations", "conv_id", "ctok"),
            vocab("ctok"),
            f"src AS (SELECT row_idx, conv_id, turn, {a} AS text_a, {b} AS text_b FROM {source})",
            tokens("src", "row_idx", "tok_a", "text_a"),
            tokens("src", "row_idx", "tok_b", "text_b"),
            encoded("src", "row_idx", "tok_a", name="enc_a"),
            encoded("src", "row_idx", "tok_b", name="enc_b"),
            """s AS (SELECT src.row_idx, conv_id, turn, enc_a.ids AS a, enc_b.ids AS b
              FROM src JOIN enc_a USING (row_idx) JOIN enc_b USING (row_idx))""",
        ]
    )


def rounds(prompt: str, history: str, form: tuple[str, str, str, str], first: int = 0) -> str:
    """Rendered history; ``form`` holds the texts before number, question, answer and after the turn."""
    before_i, before_q, before_a, end = (quoted(f) for f in form)
    turn = (
        f"list_transform({history}, lambda h, i: "
        f"concat({before_i}, i - 1 + {first}, {before_q}, h[1], {before_a}, h[2], {end}))"
    )
    return (
        f"concat(coalesce(array_to_string({turn}, ''), ''), "
        f"{before_i}, len({history}) + {first}, {before_q}, {prompt}, {before_a})"
    )


ROUND_FORM = ("[Round ", "]\n问：", "\n答：", "\n")


def packed(ids: str, block: int, batch_rows: int, keep_short: bool, source: str = "enc", key: str = "doc_id") -> str:
    """CTE ``blk (batch_id, block_id, ids)``."""
    short = "total" if keep_short else "0"
    return f"""r AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS row_idx, {ids} AS ids FROM {source}),
    f AS (SELECT row_idx // {batch_rows} AS batch_id, row_idx, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM r),
    g AS (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY row_idx, p) - 1 AS pos,
                 count(*) OVER (PARTITION BY batch_id) AS total FROM f),
    blk AS (SELECT batch_id, pos // {block} AS block_id, list(id ORDER BY pos) AS ids
            FROM g WHERE pos < CASE WHEN total >= {block} THEN total // {block} * {block} ELSE {short} END
            GROUP BY batch_id, pos // {block})"""


def draw(h: str, start: int) -> str:
    return f"('0x' || substr({h}, {start}, 8))::BIGINT"
