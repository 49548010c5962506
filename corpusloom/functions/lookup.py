"""Vocabulary lookups for whole lists, without exploding them.

The table is broadcast in Arrow form, behind a check of its size. A worker builds its index of the
table once: tokens are looked up in a hash table by their distinct values in a batch, ids by binary
search, so the cost of a batch does not depend on the size of the vocabulary. A batch is taken in
steps of bounded size, so what a worker holds beside it does not grow with the batch. The same path serves tables of every size up to that limit, in
batch and in streams; what is larger is joined, which the caller asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MAX_BYTES = 256 << 20
STEP = 1 << 18  # list values looked up at a time
KEPT_SIGNS = 1 << 22


class TableTooLarge(ValueError):
    """The table exceeds what may be broadcast."""


def _checked(table: DataFrame, token: str, value: str, max_bytes: int) -> tuple[pa.Array, pa.Array]:
    """Tokens and ids of a table whose size was summed first."""
    size = table.agg(F.sum(F.coalesce(F.octet_length(token), F.lit(0)) + 12)).first()[0] or 0
    if size > max_bytes:
        raise TableTooLarge(f"the table takes {size} bytes; at most {max_bytes} are broadcast")
    rows = table.select(F.col(token).alias("t"), F.col(value).cast("int").alias("v")).toArrow()
    return rows["t"].combine_chunks(), rows["v"].combine_chunks()


_INDEX: dict[int, object] = {}  # by broadcast, in a worker


def _index(number: int, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept for later batches and tasks of the same broadcast table."""
    if number not in _INDEX:
        if len(_INDEX) >= 4:
            _INDEX.clear()
        _INDEX[number] = build()
    return _INDEX[number]


def _first_places(values: list) -> dict:
    """Value -> the first place it is at."""
    return {v: i for i, v in reversed(list(enumerate(values)))}


def find_tokens(tokens: pa.Array, places: dict[str, int]) -> pa.Array:
    """Place of every token in the table, null where it has none."""
    coded = tokens.dictionary_encode()
    return pa.array([places.get(t) for t in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)


def find_ids(ids: pa.Array, known: np.ndarray, order: np.ndarray) -> pa.Array:
    """Place of every id in the table whose sorted ids are ``known``, null where it has none."""
    wanted = ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    missing = (known[at] != wanted if len(known) else np.ones(len(wanted), bool)) | ids.is_null().to_numpy(zero_copy_only=False)
    return pa.array(order[at] if len(known) else np.zeros(len(wanted), np.int64), mask=missing)


def steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The lists of all batches in arrays of about ``STEP`` values each; a list is never cut."""
    for lists in batches:
        ends, at = lists.offsets.to_numpy(), 0
        while at < len(lists):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
            yield lists[at:upto]
            at = upto


def values_of(lists: pa.Array) -> pa.Array:
    """The values of all lists of an array that may be a part of a larger one."""
    first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
    return lists.values.slice(first, last - first)


def relist(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of the same sizes as ``lists``, made of ``values``, one for each of ``values_of(lists)``."""
    offsets = pc.subtract(lists.offsets, lists.offsets[0])
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null() if lists.null_count else None)


class Kept:
    """What ``make`` gives for a word, kept for later batches; the words kept have ``KEPT_SIGNS`` signs at most."""

    def __init__(self, make: Callable[[str], list[int]]):
        self.make, self.found, self.signs = make, {}, 0

    def __call__(self, word: str) -> list[int]:
        ids = self.found.get(word)
        if ids is None:
            ids = self.make(word)
            self.signs += len(word)
            if self.signs > KEPT_SIGNS:
                self.found.clear()
                self.signs = len(word)
            if self.signs <= KEPT_SIGNS:
                self.found[word] = ids
        return ids


def words_to_ids(batches: Iterator[pa.Array], ids_of: Callable[[str], list[int]]) -> Iterator[pa.Array]:
    """Lists of words -> lists of the ids of all their words; each distinct word of a step is cut once."""
    for lists in steps(batches):
        coded = values_of(lists).dictionary_encode()
        pieces = pa.array([ids_of(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.int32())).take(coded.indices)
        # the pieces of a row run from those of its first word to those of its last
        starts = lists.offsets.to_numpy()
        offsets = pa.array(pieces.offsets.to_numpy()[starts - starts[0]])
        yield pa.ListArray.from_arrays(offsets, pieces.values)


def token_ids(
    table: DataFrame, unknown: int | None, token: str = "token", value: str = "id", max_bytes: int | None = None
) -> Callable[[Column], Column]:
    """List of tokens -> list of ids; ``unknown`` (or null) where the table lacks a token."""
    shared = table.sparkSession.sparkContext.broadcast(_checked(table, token, value, max_bytes or MAX_BYTES))
    number = shared._jbroadcast.id()

    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = shared.value
        places = _index(number, lambda: _first_places(tokens.to_pylist()))
        for lists in steps(batches):
            found = ids.take(find_tokens(values_of(lists), places))
            yield relist(lists, found if unknown is None else found.fill_null(unknown))

    return look_up


def id_tokens(table: DataFrame, token: str = "token", value: str = "id", max_bytes: int | None = None) -> Callable[[Column], Column]:
    """List of ids -> list of tokens; null for an id that the table lacks. Ids may be sparse."""
    shared = table.sparkSession.sparkContext.broadcast(_checked(table, token, value, max_bytes or MAX_BYTES))
    number = shared._jbroadcast.id()

    def sorted_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = ids.to_numpy(zero_copy_only=False)
        order = np.argsort(values, kind="stable")
        return values[order], order

    @F.arrow_udf("array<string>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = shared.value
        known, order = _index(number, lambda: sorted_ids(ids))
        for lists in steps(batches):
            yield relist(lists, tokens.take(find_ids(values_of(lists), known, order)))

    return look_up
