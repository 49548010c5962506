"""Document fingerprints by winnowing.

Tokens are runs of non-blank characters, cut after ``LONGEST`` code points; each Han, Hiragana,
Katakana, Hangul or Thai character is a token of its own. Every run of ``GRAM`` tokens is hashed, and of each
``WINDOW`` consecutive hashes the least is kept, the rightmost on ties, with its position. Two
texts that share a run of ``GRAM + WINDOW - 1`` tokens therefore share a fingerprint inside it. Longer
runs are cut from their start, so after an insertion their tokens differ and nothing is promised
inside them. Only
DataFrame functions are used; a text is handled inside its row.

Defined cases: null text is empty and has no fingerprint; a text of fewer tokens than ``GRAM`` has
one hash of all of them; a text of fewer hashes than ``WINDOW`` keeps its least. Two empty
fingerprints have likeness 1, an empty and another one 0. Columns of the input that clash with the
added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import let, text_of, windows_hash, without
from corpusloom.operators.order import key_ranges

GRAM, WINDOW, LONGEST = 3, 3, 24
ALONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"
TOKEN = rf"{ALONE}|[^\x20\x09-\x0D\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}\p{{IsThai}}]{{1,{LONGEST}}}"
#: A hash and its place share one number, so one comparison orders by hash and, on ties, by the later place.
PLACE_BITS = 30
PLACE_END = (1 << PLACE_BITS) - 1


def _token_hashes(tokens: Column) -> Column:
    whole = F.when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(tokens) < GRAM, whole).otherwise(windows_hash(tokens, GRAM))


def _pair_least(values: Column, step: int) -> Column:
    """values[i] or values[i + step], the lesser; past the end the first alone."""

    def pairs(v: Column) -> Column:
        ahead = F.slice(v, F.lit(step + 1), F.greatest(F.size(v) - step, F.lit(0)))
        return F.zip_with(v, ahead, lambda x, y: F.least(x, y))

    return let(values, pairs)


def _least_of_windows(placed: Column, window: int) -> Column:
    """The least of every ``window`` consecutive numbers, by doubling steps."""
    out, span = placed, 1
    while span < window:
        step = min(span, window - span)
        out = _pair_least(out, step)
        span += step
    return out


def packed_fingerprint(text: Column) -> Column:
    """The kept hashes of a text with their places, by place, one number each."""
    high = (1 << (63 - PLACE_BITS)) - 1
    packed = lambda hs: F.transform(
        hs, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(high)), PLACE_BITS) + (F.lit(PLACE_END).cast("bigint") - i)
    )
    least = lambda v: F.slice(
        _least_of_windows(v, WINDOW), F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.least(F.size(v), F.lit(1)))
    )
    tokens = F.regexp_extract_all(text_of(text), F.lit(TOKEN), F.lit(0))
    kept = let(let(let(tokens, _token_hashes), packed), least)
    return F.array_distinct(kept)


def unpack(prints: Column) -> Column:
    """array<struct<hash bigint, place int>>; ``place`` is the token the run of tokens begins at."""
    return F.transform(
        prints,
        lambda v: F.struct(
            F.shiftright(v, PLACE_BITS).alias("hash"),
            (F.lit(PLACE_END) - v.bitwiseAND(F.lit(PLACE_END))).cast("int").alias("place"),
        ),
    )


def fingerprint(text: Column) -> Column:
    return unpack(packed_fingerprint(text))


def as_text(prints: Column) -> Column:
    """``hash@place`` in hexadecimal and decimal, by place, with blanks between."""
    return F.array_join(F.transform(prints, lambda p: F.concat_ws("@", F.lower(F.hex(p["hash"])), p["place"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints."""
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(either))


def with_next(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Add the values of ``columns`` (name -> value), and as ``next_<name>`` those of the next row in
    descending order of ``key``; after the last row comes the first. Null keys come last, equal keys
    in the order of the first value.

    The key is cut into ranges of the reversed order, and each range also gets the rows that begin
    the range after it, so the next row is always in the same partition and rows move once. The
    values are computed behind that shuffle.
    """
    reverse = [F.col(key).isNull().cast("int"), -F.coalesce(F.col(key), F.lit(0))]
    plan = key_ranges(docs, reverse)
    last = len(plan.bounds)
    at = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(reverse)])
    lowest = docs.select(F.min(at).alias("k")).first().k
    first = F.lit(False) if lowest is None else (reverse[0] == lowest.k0) & (reverse[1] == lowest.k1)
    own = F.struct(plan.range_col().alias("__range"), F.lit(0).alias("__guest"))
    # A guest row stands behind all own rows of a range and is left out afterwards.
    guest = F.when(plan.begins(), F.struct((plan.range_col() - 1).alias("__range"), F.lit(1).alias("__guest")))
    around = F.when(first, F.struct(F.lit(last).alias("__range"), F.lit(1).alias("__guest")))
    places = F.filter(F.array(own, guest, around), lambda p: p.isNotNull())
    spread = docs.select("*", F.inline(places)).repartitionById(last + 1, F.col("__range"))
    spread = spread.withColumns(columns)
    order = Window.partitionBy("__range").orderBy("__guest", F.desc_nulls_last(key), F.asc_nulls_first(next(iter(columns))))
    out = spread.withColumns({f"next_{n}": F.lead(n).over(order) for n in columns}).where(F.col("__guest") == 0)
    return out.drop("__range", "__guest")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its fingerprint, that of the next document, and its edited text: the last
    third of its code points replaced by the first as many of the next document."""
    docs = without(docs, "prints", "whole", "next_whole", "next_prints", "n_chars", "edited", "edited_prints")
    told = {"whole": text_of(text), "prints": packed_fingerprint(F.col(text))}
    paired = with_next(docs, key, told).withColumn("n_chars", F.length("whole").cast("bigint"))
    cut = F.expr("n_chars div 3").cast("int")
    edited = F.concat(F.substring("whole", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_whole", F.lit(1), cut))
    out = paired.withColumn("edited", edited).withColumn("edited_prints", packed_fingerprint(F.col("edited")))
    return out.withColumns({c: unpack(F.col(c)) for c in ("prints", "next_prints", "edited_prints")}).drop("whole", "next_whole")
