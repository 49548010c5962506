"""Training a merge list: word counts once, then a few rounds over the word table.

A word is kept as text with every symbol between two marks. A round counts all pairs and calls the
most frequent ones hot. As long as only pairs above the count of the best cold pair are merged,
nothing outside the runs of symbols that hot pairs join can matter: a pair that a merge brings into
being beside a cold pair counts at most as much as that one. So equal runs of all words are summed
by a shuffle, the driver does the merges one by one on the distinct runs, with an index from pairs
to the runs that hold them, until the best pair is no longer above the cold ones, and the next
round applies these merges to the word table. The driver holds ``MAX_RUNS`` distinct runs at most,
whatever the corpus: where there are more, fewer pairs are hot. Thousands of merges take a dozen
rounds, and the result is that of training one by one on all words.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import words
from corpusloom.operators.order import with_row_index
from corpusloom.operators.vocab import token_counts
from corpusloom.session import cut_lineage

OPEN, CLOSE = "\x01", "\x02"
MAX_HOT, MAX_RUNS = 65_536, 65_536


def bpe_word_counts(
    df: DataFrame, text: str | Column, split: Callable[[Column], Column] = words, min_count: int = 1
) -> DataFrame:
    """``(token, n)`` of the pieces that merges are learned from."""
    counts = token_counts(df, text, split)
    return counts.where(F.col("n") >= min_count) if min_count > 1 else counts


def _marked(token: Column) -> Column:
    """Every character of a word between the two marks."""
    return F.regexp_replace(token, r"(?s)(.)", f"{OPEN}$1{CLOSE}")


def symbol_table(word_counts: DataFrame) -> DataFrame:
    """``(symbols, n)``; words made of the mark characters cannot be trained on.

    The counts are written once: filters on a word would else be moved before the counting and be
    worked out for every place it is at.
    """
    word_counts = cut_lineage(word_counts, "word-counts")
    sound = ~F.col("token").rlike(f"[{OPEN}{CLOSE}]")
    return word_counts.where(sound).select(_marked(F.col("token")).alias("symbols"), "n")


def _symbols() -> Column:
    return F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), f"{CLOSE}{OPEN}")


def _pairs_of(table: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("left"), F.slice("p", 2, F.size("p") - 1).alias("right"))
    return (
        table.select(_symbols().alias("p"), "n")
        .where(F.size("p") > 1)
        .select(F.explode(pairs).alias("pair"), "n")
        .select("pair.left", "pair.right", "n")
    )


def bpe_pair_counts(table: DataFrame) -> DataFrame:
    """``(left, right, n)``: adjacent symbol pairs weighted with the counts of their words."""
    return _pairs_of(table).groupBy("left", "right").agg(F.sum("n").alias("n"))


def _parts(symbols: str) -> list[str]:
    return symbols[1:-1].split(CLOSE + OPEN)


def _whole(parts: list[str]) -> str:
    return OPEN + (CLOSE + OPEN).join(parts) + CLOSE


def merge_pair(symbols: list[str], left: str, right: str) -> list[str]:
    """One merge, from left to right."""
    out, i = [], 0
    while i < len(symbols):
        if symbols[i] == left and i + 1 < len(symbols) and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def merge_in_order(symbols: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """All merges one after the other, each once: a pair that comes back after its turn stays."""
    last = -1
    while len(symbols) > 1:
        ahead = [(r, p) for p in zip(symbols, symbols[1:]) for r in ranks.get(p, ()) if r > last]
        if not ahead:
            break
        last, (left, right) = min(ahead)
        symbols = merge_pair(symbols, left, right)
    return symbols


def _mapped(table: DataFrame, change: Callable[[list[str]], Iterator[list[str]]]) -> DataFrame:
    """``(symbols, n)`` with every word replaced by what ``change`` gives for its symbols."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, n = [], []
            for symbols, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for parts in change(_parts(symbols)):
                    made.append(_whole(parts))
                    n.append(count)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(n, pa.int64())], ["symbols", "n"])

    return table.select("symbols", "n").mapInArrow(words_of, "symbols string, n bigint")


def merged_words(table: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """The word table after the given merges, one after the other."""
    ranks: dict[tuple[str, str], list[int]] = defaultdict(list)
    for rank, pair in enumerate(merges):
        ranks[pair].append(rank)
    ranks = dict(ranks)
    return _mapped(table, lambda parts: iter([merge_in_order(parts, ranks)]))


def hot_runs(table: DataFrame, hot: set[tuple[str, str]]) -> DataFrame:
    """``(symbols, n)``: the longest runs of symbols that hot pairs join, equal ones summed."""

    def runs(parts: list[str]) -> Iterator[list[str]]:
        start = 0
        for i in range(1, len(parts) + 1):
            if i == len(parts) or (parts[i - 1], parts[i]) not in hot:
                if i - start > 1:
                    yield parts[start:i]
                start = i

    return _mapped(table, runs).groupBy("symbols").agg(F.sum("n").alias("n"))


def merges_above(
    runs: Sequence[tuple[list[str], int]], first: tuple[str, str], cold: int, room: int, known: set[str]
) -> list[tuple[str, str]]:
    """The merges that one-by-one training does next, as far as the runs tell them.

    ``first`` is the best pair of all. Later ones must count more than ``cold``. A token that two
    merges spell is one symbol, and pairs with it add up over places the runs may not show, at most
    ``cold`` for each way of spelling either side; such a pair is never taken, and the merges end
    where it could be the best. ``room`` is the number of new tokens wanted; ``known`` grows by them.
    """
    runs = [(list(symbols), n) for symbols, n in runs]
    counts: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (symbols, n) in enumerate(runs):
        for pair in zip(symbols, symbols[1:]):
            counts[pair] += n
            where[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    ways: dict[str, int] = {}
    unsure: set[tuple[str, str]] = set()
    done: list[tuple[str, str]] = []
    while heap and room > 0:
        n, left, right = heapq.heappop(heap)
        pair, n = (left, right), -n
        if counts.get(pair) != n:
            continue
        if not done:
            pair = first
        else:
            doubled = [w for w in ways.values() if w > 1]
            hidden = cold * max(doubled) ** 2 if doubled else 0
            if n <= cold or pair in unsure or (doubled and max((counts.get(p, 0) for p in unsure), default=0) + hidden >= n):
                break
        done.append(pair)
        token = pair[0] + pair[1]
        if token in known:
            ways[token] = ways.get(token, 1) + 1
            unsure |= {p for p in counts if token in p}
        else:
            known.add(token)
            ways[token] = 1
            room -= 1
        changed: dict[tuple[str, str], int] = defaultdict(int)
        for i in where.pop(pair):
            symbols, times = runs[i]
            for p in zip(symbols, symbols[1:]):
                changed[p] -= times
            symbols = merge_pair(symbols, *pair)
            for p in zip(symbols, symbols[1:]):
                changed[p] += times
                where[p].add(i)
            runs[i] = symbols, times
        for p, by in changed.items():
            if by:
                counts[p] += by
                if counts[p]:
                    heapq.heappush(heap, (-counts[p], *p))
                if ways.get(p[0], 1) > 1 or ways.get(p[1], 1) > 1:
                    unsure.add(p)
    return done


def train_bpe(
    df: DataFrame,
    text: str | Column,
    vocab_size: int = 30_000,
    specials: Sequence[str] = ("<|endoftext|>",),
    split: Callable[[Column], Column] = words,
    min_count: int = 1,
    max_merges: int | None = None,
    max_hot: int = MAX_HOT,
    max_runs: int = MAX_RUNS,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``(token, id)`` and merges ``(rank, left, right)``.

    Ids: special tokens, then the single symbols in order, then the merges. The best pair has the
    highest count, and among equals the smallest symbols. Training ends at ``vocab_size`` or when
    no pair is left. ``max_hot`` pairs and ``max_runs`` distinct runs come to the driver in a round;
    they set the number of rounds, not the result, which is that of training one by one.
    """
    spark = df.sparkSession
    counted = symbol_table(bpe_word_counts(df, text, split, min_count))
    # Every round scans this table, so it is spread evenly, however few bytes it has.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = cut_lineage(counted.repartition(partitions), "bpe-words")
    alphabet = cut_lineage(table.select(F.explode(_symbols()).alias("token")).distinct(), "bpe-alphabet")
    n_alphabet = alphabet.count()
    room = max(0, vocab_size - len(specials) - n_alphabet)
    if max_merges is not None:
        room = min(room, max_merges)
    merges: list[tuple[str, str]] = []
    made: set[str] = set()
    hot = max_hot
    while len(made) < room:
        pairs = bpe_pair_counts(table)
        ranked = [(r.left, r.right, r.n) for r in pairs.orderBy(F.desc("n"), "left", "right").limit(max_hot + 1).collect()]
        if not ranked:
            break
        while True:
            # One hot pair gives its own runs only, one for each length of a repeated symbol.
            chosen = {(left, right) for left, right, _ in ranked[:hot]}
            found = hot_runs(table, chosen).limit(max_runs + 1).collect()
            if len(found) <= max_runs or hot == 1:
                break
            hot = max(1, min(hot, len(ranked)) // 4)
        cold = ranked[hot][2] if len(ranked) > hot else 0
        runs = [(_parts(r.symbols), r.n) for r in found]
        done = merges_above(runs, ranked[0][:2], cold, room - len(made), made)
        merges += done
        table = cut_lineage(merged_words(table, done), "bpe-words")
        hot = min(max_hot, hot * 2)
    merge_rows = [(i, left, right) for i, (left, right) in enumerate(merges)]
    merge_table = spark.createDataFrame(merge_rows, "rank int, left string, right string")
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    singles = with_row_index(alphabet, "token", "id").select(
        "token", (F.col("id") + len(specials)).cast("int").alias("id")
    )
    # Two merges can spell the same token; it keeps the id of the first.
    tokens = list(dict.fromkeys(left + right for left, right in merges))
    base = len(specials) + n_alphabet
    joined = spark.createDataFrame([(t, base + i) for i, t in enumerate(tokens)], "token string, id int")
    return fixed.unionByName(singles).unionByName(joined), merge_table
