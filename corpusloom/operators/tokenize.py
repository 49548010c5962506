"""Encoding and decoding of corpora."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.lookup import Kept, TableTooLarge, id_tokens, token_ids, words_to_ids
from corpusloom.functions.sequences import (
    Specials,
    add_special,
    as_col,
    cut,
    pad_right,
    special_mask as special_mask_of,
)
from corpusloom.functions.text import byte_level_words, words
from corpusloom.session import cut_lineage

HOT_ENTRIES = 32_768
NO_IDS = "array<int>"


class Tokenizer(Protocol):
    """What the sequence builders need from a tokenizer."""

    specials: Specials
    model_max_length: int

    def with_ids(self, df: DataFrame, texts: dict[str, Column | str], key: str | None = None) -> DataFrame:
        """Add one id list column per entry of ``texts`` (column name -> text).

        ``WordTokenizer`` also takes ``limit``: only so many ids are looked up.
        """
        ...

    def decoded(self, df: DataFrame, ids: str, out: str, key: str | None = None) -> DataFrame:
        """Add the list of tokens behind the id list ``ids``."""
        ...


def _empty(dtype: str) -> Column:
    return F.array().cast(dtype)


class WordTokenizer:
    """Words and single signs looked up in a ``(token, id)`` table; unknown words get ``unk``.

    The table is broadcast, whatever its size up to ``max_bytes``, and looked up inside the row, in
    batch and in streams; more is an error. With ``join`` the most frequent entries (smallest ids)
    are looked up that way and all other tokens are joined by value, for tables of every word of a
    large corpus; that needs ``key``, a unique row column.
    """

    def __init__(
        self,
        vocab: DataFrame,
        specials: Specials = Specials(),
        model_max_length: int = 1 << 30,
        split: Callable[[Column], Column] = words,
        join: bool = False,
        max_bytes: int | None = None,
    ):
        self.vocab = vocab.select("token", F.col("id").cast("int").alias("id"))
        self.specials = specials
        self.model_max_length = model_max_length
        self.split = split
        self.join, self.max_bytes = join, max_bytes
        self._lookup: Callable[[Column], Column] | None = None
        self._decode: Callable[[Column], Column] | None = None

    def tokens(self, text: Column | str, limit: int | None = None) -> Column:
        tokens = F.coalesce(self.split(as_col(text)), _empty("array<string>"))
        return tokens if limit is None else cut(tokens, limit)

    def plain(self, text: Column | str) -> Column:
        """What encoding and decoding give back where every token is known."""
        return self.text_of(self.tokens(text))

    def text_of(self, tokens: Column) -> Column:
        return F.array_join(tokens, " ")

    def ids(self, text: Column | str, limit: int | None = None) -> Column:
        """Id list as a Column."""
        if self._lookup is None:
            self._lookup = token_ids(self.vocab, self.specials.unk, max_bytes=self.max_bytes)
        return self._lookup(self.tokens(text, limit))

    def with_ids(
        self, df: DataFrame, texts: dict[str, Column | str], key: str | None = None, limit: int | None = None
    ) -> DataFrame:
        if not self.join:
            return df.withColumns({out: self.ids(text, limit) for out, text in texts.items()})
        if key is None:
            raise ValueError("a joined vocabulary needs the unique row column as key")
        for out, text in texts.items():
            df = self._joined_ids(df, out, text, key, limit)
        return df

    def _joined_ids(self, df: DataFrame, out: str, text: Column | str, key: str, limit: int | None) -> DataFrame:
        if self._lookup is None:
            self._lookup = token_ids(self.vocab.where(F.col("id") < self.specials.first_free + HOT_ENTRIES), None)
        split = df.withColumn("__t", self.tokens(text, limit)).withColumn("__i", self._lookup(F.col("__t")))
        # Rare tokens in row order: the i-th of them belongs to the i-th gap. Split and looked up once, for both readers.
        rare = F.transform(F.filter(F.arrays_zip("__t", "__i"), lambda z: z["__i"].isNull()), lambda z: z["__t"])
        split = cut_lineage(split.withColumn("__t", rare), "joined-tokens")
        found = (
            split.select(key, F.posexplode("__t").alias("gap", "token"))
            .join(self.vocab, "token", "left")
            .groupBy(key)
            .agg(
                F.array_sort(
                    F.collect_list(F.struct("gap", F.coalesce("id", F.lit(self.specials.unk)).alias("id")))
                ).alias("__rare")
            )
            .withColumn("__rare", F.transform("__rare", lambda g: g["id"].cast("string")))
        )
        # "5 _ 7" cut at the gaps, each piece followed by the id of its gap: linear in the row.
        pieces = F.split(F.array_join(F.col("__i").cast("array<string>"), " ", "_"), "_")
        filled = F.zip_with(
            pieces,
            F.coalesce("__rare", _empty("array<string>")),
            lambda piece, gap: F.concat(piece, F.coalesce(gap, F.lit(""))),
        )
        ids = F.when(F.size("__i") == 0, _empty(NO_IDS)).otherwise(
            F.split(F.array_join(filled, ""), " ").cast(NO_IDS)
        )
        return split.join(found, key, "left").withColumn(out, ids).drop("__t", "__i", "__rare")

    def _named(self) -> DataFrame:
        spark = self.vocab.sparkSession
        names = [(name, i) for i, name in self.specials.names.items()]
        return self.vocab.unionByName(spark.createDataFrame(names, "token string, id int"))

    def decoded(self, df: DataFrame, ids: str, out: str, key: str | None = None) -> DataFrame:
        if not self.join:
            if self._decode is None:
                self._decode = id_tokens(self._named(), max_bytes=self.max_bytes)
            return df.withColumn(out, self._decode(F.col(ids)))
        if key is None:
            raise ValueError("a joined vocabulary needs the unique row column as key")
        found = (
            df.select(key, F.posexplode(ids).alias("pos", "id"))
            .join(self._named(), "id", "left")
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("__p"))
            .select(key, F.transform("__p", lambda p: p["token"]).alias(out))
        )
        return df.join(found, key, "left").withColumn(out, F.coalesce(out, _empty("array<string>")))


# --- BPE ------------------------------------------------------------------------------------------


def _byte_alphabet() -> tuple[str, str]:
    """Bytes without a visible sign of their own, and the signs that stand for them.

    Rule of the byte-level alphabet: visible Latin-1 signs stay, the others are numbered from 256.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return "".join(map(chr, hidden)), "".join(chr(256 + n) for n in range(len(hidden)))


def to_byte_signs(text: Column) -> Column:
    """UTF-8 bytes written as one visible sign each."""
    hidden, signs = _byte_alphabet()
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), hidden, signs)


def from_byte_signs(signs_text: Column) -> Column:
    hidden, signs = _byte_alphabet()
    return F.decode(F.encode(F.translate(signs_text, signs, hidden), "ISO-8859-1"), "UTF-8")


def byte_level_split(text: Column) -> Column:
    """Byte-level pieces of a text in byte signs."""
    return F.transform(byte_level_words(text), to_byte_signs)


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges to one word, lowest rank first and from the left.

    A heap holds the merges that are possible; symbols are linked, so a merge costs the logarithm of
    the length and long words (base64, scripts without blanks) stay cheap.
    """
    symbols, after = list(symbols), list(range(1, len(symbols) + 1))
    before = [i - 1 for i in range(len(symbols))]
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] else len(symbols)
        if j >= len(symbols) or symbols[i] != left or symbols[j] != right:
            continue  # one of the two was merged before
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for at in (before[i], i):
            if at >= 0 and after[at] < len(symbols):
                pair = symbols[at], symbols[after[at]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], at, *pair))
    return [s for s in symbols if s]


class BpeTokenizer:
    """Merge-list tokenizer. Text is split in the JVM; merging runs in Arrow batches.

    Each Python worker keeps the ids of words it has seen, as far as they are short in all. Vocabulary and merge list are bounded by
    the vocabulary size they were trained for; above ``MAX_TABLE`` rows they are refused.
    """

    MAX_TABLE = 1_000_000

    def __init__(
        self,
        vocab: DataFrame,
        merges: DataFrame,
        specials: Specials = Specials(),
        model_max_length: int = 1 << 30,
        split: Callable[[Column], Column] = byte_level_split,
        byte_level: bool = True,
    ):
        self.specials, self.model_max_length = specials, model_max_length
        self.split, self.byte_level = split, byte_level
        self.vocab = vocab.select("token", F.col("id").cast("int").alias("id"))
        ids = {r.token: r.id for r in self._rows(self.vocab)}
        ranks: dict[tuple[str, str], int] = {}
        for row in self._rows(merges.select("rank", "left", "right")):
            ranks[row.left, row.right] = min(row.rank, ranks.get((row.left, row.right), row.rank))
        tables = vocab.sparkSession.sparkContext.broadcast((ids, ranks))
        unk = specials.unk

        @F.arrow_udf("array<int>")
        def bpe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids, ranks = tables.value
            yield from words_to_ids(batches, Kept(lambda word: [ids.get(s, unk) for s in merge_symbols(list(word), ranks)]))

        self._bpe = bpe
        self._decode: Callable[[Column], Column] | None = None

    def _rows(self, table: DataFrame) -> list:
        rows = table.limit(self.MAX_TABLE + 1).collect()
        if len(rows) > self.MAX_TABLE:
            raise TableTooLarge(f"tokenizer table has more than {self.MAX_TABLE} rows")
        return rows

    def with_ids(self, df: DataFrame, texts: dict[str, Column | str], key: str | None = None) -> DataFrame:
        none = _empty("array<string>")
        return df.withColumns(
            {out: self._bpe(F.coalesce(self.split(as_col(text)), none)) for out, text in texts.items()}
        )

    def decoded(self, df: DataFrame, ids: str, out: str, key: str | None = None) -> DataFrame:
        return WordTokenizer.decoded(self._as_words(), df, ids, out, key)

    def plain(self, text: Column | str) -> Column:
        """What encoding and decoding give back where every symbol is known."""
        return F.coalesce(as_col(text), F.lit(""))

    def _as_words(self) -> WordTokenizer:
        if getattr(self, "_words", None) is None:
            self._words = WordTokenizer(self.vocab, self.specials)
        return self._words

    def text_of(self, tokens: Column) -> Column:
        """Tokens joined back to the text they came from."""
        joined = F.array_join(tokens, "")
        return from_byte_signs(joined) if self.byte_level else joined


# --- operators ------------------------------------------------------------------------------------


def encode(
    df: DataFrame,
    text: str | Column,
    tokenizer: Tokenizer,
    special: bool | str = False,
    max_length: int | None = None,
    pad_to: int | None = None,
    special_mask: bool = False,
    attention_mask: bool = True,
    keep_source: tuple[str, ...] = (),
    key: str | None = None,
) -> DataFrame:
    """Text to ``input_ids`` (+ ``attention_mask``, ``special_tokens_mask``).

    ``special`` adds specials in the sentence layout, or in the layout named. Truncation leaves
    room for them, padding comes last.
    """
    sp = tokenizer.specials
    layout = "sentence" if special is True else special
    keep = list(dict.fromkeys([*keep_source, *([key] if key else [])]))
    text = as_col(text)
    rows, ids = df.select(*keep, text.alias("__text")), F.col("input_ids")
    limit = None if max_length is None else max_length - (2 if layout else 0)
    if isinstance(tokenizer, WordTokenizer):
        out = tokenizer.with_ids(rows, {"input_ids": "__text"}, key, limit).drop("__text")
    else:
        out = tokenizer.with_ids(rows, {"input_ids": "__text"}, key).drop("__text")
        ids = ids if limit is None else cut(ids, limit)
    if layout:
        ids = add_special(ids, sp, layout)
    out = out.withColumn("input_ids", ids)
    keep_final = [c for c in keep if c in keep_source or c == key]
    return with_masks(out.select(*keep_final, "input_ids"), sp, pad_to, special_mask, attention_mask)


def with_masks(
    df: DataFrame,
    specials: Specials,
    pad_to: int | None = None,
    special_mask: bool = False,
    attention_mask: bool = True,
) -> DataFrame:
    """Pad ``input_ids`` and add the masks, which follow from the ids: rows that are written or moved can do without."""
    built: dict[str, Column] = {}
    if attention_mask:
        real = F.array_repeat(F.lit(1), F.size("input_ids"))
        built["attention_mask"] = real if pad_to is None else pad_right(real, pad_to, 0)
    padded = F.col("input_ids") if pad_to is None else pad_right("input_ids", pad_to, specials.pad)
    if special_mask:
        built["special_tokens_mask"] = special_mask_of(padded, specials)
    kept = [c for c in df.columns if c != "input_ids"]
    return df.select(*kept, padded.alias("input_ids"), *[c.alias(n) for n, c in built.items()])


def decode(
    df: DataFrame, ids: str, tokenizer: Tokenizer, per_token: bool = False, out: str = "text", key: str | None = None
) -> DataFrame:
    """Id list to text, or to the list of tokens with ``per_token``."""
    df = tokenizer.decoded(df, ids, out, key)
    if per_token:
        return df
    return df.withColumn(out, tokenizer.text_of(F.col(out)))


def roundtrip_report(
    df: DataFrame, text: str, tokenizer: WordTokenizer | BpeTokenizer, key: str | None = None
) -> DataFrame:
    """Encode, decode and compare: one row with mismatching rows, unknown tokens and sizes."""
    keep = (key,) if key else ()
    df = df.select(*keep, F.col(text).alias("__text"), tokenizer.plain(text).alias("__want"))
    df = tokenizer.decoded(tokenizer.with_ids(df, {"__ids": "__text"}, key), "__ids", "__back", key)
    unknown = F.size(F.filter("__ids", lambda x: x == tokenizer.specials.unk))
    tokens, chars = F.sum(F.size("__ids")), F.sum(F.length("__text"))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(tokenizer.text_of(F.col("__back")) != F.col("__want")).alias("mismatched_rows"),
        tokens.alias("tokens"),
        F.sum(unknown).cast("bigint").alias("unknown_tokens"),
        F.round(F.sum(unknown) / F.nullif(tokens, F.lit(0)), 6).alias("unknown_rate"),
        F.round(tokens / F.nullif(chars, F.lit(0)), 6).alias("tokens_per_char"),
    )


def overlength_report(df: DataFrame, limit: int, ids: str = "input_ids") -> DataFrame:
    """How many rows are longer than the model limit, and the longest."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size(ids) > limit).alias("over_limit"),
        F.max(F.size(ids)).alias("longest"),
    )
