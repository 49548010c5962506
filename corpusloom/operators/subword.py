"""Subword tokenizers over a vocabulary table: greedy longest match, and best segmentation by scores.

Text is split in the JVM. The distinct words of a part of a batch are segmented once each, and a
worker keeps what it has segmented, up to a bound; the vocabulary is broadcast behind a check of its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.lookup import MAX_BYTES, Kept, TableTooLarge, id_tokens, words_to_ids
from corpusloom.functions.sequences import Specials, as_col
from corpusloom.functions.text import words
from corpusloom.operators.vocab import token_counts

CONTINUED, MARK = "##", "▁"
UNKNOWN_PENALTY = 10_000  # below the least score, in the unit of the scores


class LongestMatch:
    """Ids of a word: from the left, always the longest piece the vocabulary has; pieces behind the
    first carry the continuation sign. A word that cannot be covered, or of more than ``max_chars``,
    is one unknown."""

    def __init__(self, rows: Iterable[tuple], unk: int, max_chars: int):
        self.ids, self.unk, self.max_chars = dict(rows), unk, max_chars
        # All beginnings of all pieces: the trie, walked one sign at a time.
        self.begun = {piece[:i] for piece in self.ids for i in range(1, len(piece) + 1)}

    def __call__(self, word: str) -> list[int]:
        if len(word) > self.max_chars:
            return [self.unk]
        found, at = [], 0
        while at < len(word):
            lead = CONTINUED if at else ""
            end, last, best = at, at, None
            while end < len(word) and lead + word[at : end + 1] in self.begun:
                end += 1
                piece = self.ids.get(lead + word[at:end])
                if piece is not None:
                    last, best = end, piece
            if best is None:
                return [self.unk]
            found.append(best)
            at = last
        return found


class BestScores:
    """Ids of the segmentation of a word with the highest sum of scores (Viterbi over the lattice of
    pieces). A character that is no piece can be an unknown, below every score. Among equal sums the
    longest last piece wins, at every place."""

    def __init__(self, rows: Iterable[tuple], unk: int):
        rows = list(rows)
        self.pieces = {token: (score, i) for token, i, score in rows}
        # All beginnings of all pieces: the trie, walked one sign at a time; those that are a piece have its score and id.
        self.begun = {piece[:i]: self.pieces.get(piece[:i]) for piece in self.pieces for i in range(1, len(piece) + 1)}
        self.unknown = (min((score for _, _, score in rows), default=0) - UNKNOWN_PENALTY, unk)

    def __call__(self, word: str) -> list[int]:
        size, get, nothing = len(word), self.begun.get, ()
        sums, begins, ids = [0] + [-math.inf] * size, [0] * (size + 1), [0] * (size + 1)
        for begin in range(size):
            # Every place is reached, as the sign before it can be an unknown. Longer pieces come first to their end.
            before = sums[begin]
            if not get(word[begin]) and before + self.unknown[0] > sums[begin + 1]:
                sums[begin + 1], begins[begin + 1], ids[begin + 1] = before + self.unknown[0], begin, self.unknown[1]
            for end in range(begin + 1, size + 1):
                piece = get(word[begin:end], nothing)
                if piece is nothing:
                    break
                if piece and before + piece[0] > sums[end]:
                    sums[end], begins[end], ids[end] = before + piece[0], begin, piece[1]
        found, at = [], size
        while at:
            found.append(ids[at])
            at = begins[at]
        return found[::-1]


_SEGMENTERS: dict[int, Kept] = {}  # by broadcast, in a worker


class SubwordTokenizer:
    """What both tokenizers share: words to ids in Arrow batches, ids to text by lookup."""

    def __init__(self, vocab: DataFrame, columns: list[str], make: Callable, specials: Specials, model_max_length: int, split, max_bytes: int):
        self.specials, self.model_max_length, self.split, self.max_bytes = specials, model_max_length, split, max_bytes
        self.vocab = vocab.select("token", F.col("id").cast("int").alias("id"), *columns)
        size = self.vocab.agg(F.sum(F.octet_length("token") + 12)).first()[0] or 0
        if size > max_bytes:
            raise TableTooLarge(f"the vocabulary takes {size} bytes; at most {max_bytes} are broadcast")
        shared = vocab.sparkSession.sparkContext.broadcast([tuple(r) for r in self.vocab.collect()])
        number = shared._jbroadcast.id()

        @F.arrow_udf("array<int>")
        def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if number not in _SEGMENTERS:
                _SEGMENTERS.clear()
                _SEGMENTERS[number] = Kept(make(shared.value))
            yield from words_to_ids(batches, _SEGMENTERS[number])

        self._segment = segment
        self._decode: Callable[[Column], Column] | None = None

    def ids(self, text: Column | str) -> Column:
        return self._segment(F.coalesce(self.split(as_col(text)), F.array().cast("array<string>")))

    def with_ids(self, df: DataFrame, texts: dict[str, Column | str], key: str | None = None) -> DataFrame:
        return df.withColumns({out: self.ids(text) for out, text in texts.items()})

    def decoded(self, df: DataFrame, ids: str, out: str, key: str | None = None) -> DataFrame:
        if self._decode is None:
            named = df.sparkSession.createDataFrame([(t, i) for i, t in self.specials.names.items()], "token string, id int")
            self._decode = id_tokens(self.vocab.select("token", "id").unionByName(named), max_bytes=self.max_bytes)
        return df.withColumn(out, self._decode(F.col(ids)))


class LongestMatchTokenizer(SubwordTokenizer):
    """Words cut greedily into the longest pieces of ``vocab (token, id)``."""

    def __init__(
        self,
        vocab: DataFrame,
        specials: Specials = Specials(),
        model_max_length: int = 1 << 30,
        split: Callable[[Column], Column] = words,
        max_chars: int = 100,
        max_bytes: int = MAX_BYTES,
    ):
        unk = specials.unk
        super().__init__(vocab, [], lambda rows: LongestMatch(rows, unk, max_chars), specials, model_max_length, split, max_bytes)

    def plain(self, text: Column | str) -> Column:
        return F.array_join(F.coalesce(self.split(as_col(text)), F.array().cast("array<string>")), " ")

    def text_of(self, tokens: Column) -> Column:
        return F.replace(F.array_join(tokens, " "), F.lit(" " + CONTINUED), F.lit(""))


def marked_words(text: Column | str) -> Column:
    """Runs without blanks, each behind the sign that stands for the blank before it."""
    runs = F.regexp_extract_all(as_col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.transform(runs, lambda w: F.concat(F.lit(MARK), w))


class ScoreTokenizer(SubwordTokenizer):
    """Words cut into the pieces of ``vocab (token, id, score)`` whose scores sum up highest."""

    def __init__(
        self,
        vocab: DataFrame,
        specials: Specials = Specials(),
        model_max_length: int = 1 << 30,
        split: Callable[[Column], Column] = marked_words,
        max_bytes: int = MAX_BYTES,
    ):
        unk = specials.unk
        super().__init__(vocab, ["score"], lambda rows: BestScores(rows, unk), specials, model_max_length, split, max_bytes)

    def plain(self, text: Column | str) -> Column:
        return self.text_of(F.coalesce(self.split(as_col(text)), F.array().cast("array<string>")))

    def text_of(self, tokens: Column) -> Column:
        return F.ltrim(F.replace(F.array_join(tokens, ""), F.lit(MARK), F.lit(" ")))


def piece_counts(df: DataFrame, text: str, split: Callable[[Column], Column], longest: int, continued: str = "") -> DataFrame:
    """``(token, n)``: all substrings of up to ``longest`` signs of the words, and the words themselves;
    those that do not begin a word carry ``continued``. The candidates vocabularies are chosen from."""
    counts = token_counts(df, text, split)
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("token")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.length("token") - i + 1)),
                lambda k: F.concat(F.when(i > 1, F.lit(continued)).otherwise(""), F.substring("token", i, k)),
            ),
        )
    )
    whole = F.when(F.length("token") > longest, F.array("token")).otherwise(F.array().cast("array<string>"))
    return counts.where(F.length("token") > 0).select(F.explode(F.concat(places, whole)).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
