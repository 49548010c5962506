"""Quality rules with adaptive thresholds per language and source.

Each document gets shares (marks per word, repeated lines, repeated words, capitals) and its mean
word length, as whole numbers; marks are all characters but letters, digits and blanks. Their distribution per language and source is kept in a mergeable
quantile sketch: a table of counts per value rounded down to its ``BITS`` leading bits, so a
quantile is off by less than one part in 2^(BITS - 1), sketches merge by adding counts, and the
result depends on no order.

A threshold lies ``reach`` spreads outside the quartiles. The spread is the distance of the
quartiles, at least a 20th of the upper one, so that many copies of one text do not make the rest
outliers. Most texts repeat no line and no words, so the quartiles of these two are those of the
documents that do repeat some. The threshold is the wider one of the language and source and of
the language as a whole (the merged sketches); a sketch of fewer than ``MIN_ROWS`` rows has none,
and then the other decides. No upper threshold is below the rule's ``floor``, which is also taken
where neither has enough rows; without a floor such a rule rejects nothing. Documents that fail the
base rule are left out of the sketches. Only DataFrame functions are used.

Defined cases: null or empty text has no words and fails the base rule; null languages and
sources form groups of their own; repeated rows count each; an empty table stays empty. Columns
of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import BLANKS, WORD, group_key, let, text_of, windows_hash, without, word_list
from corpusloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MARK = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RUN = 8
BITS = 6
MIN_ROWS = 20
LEAST_SPREAD = 20


@dataclass(frozen=True)
class Rule:
    """``shown``: quartiles of the values above 0 only; ``both``: small values can be outlying too."""

    reach: int
    floor: int | None = None
    shown: bool = False
    both: bool = False


VALUES = {
    "symbols": Rule(8, floor=1_000),
    "dup_lines": Rule(3, floor=3_000, shown=True),
    "repeats": Rule(3, floor=1_500, shown=True),
    "capitals": Rule(10),
    "word_length": Rule(6, both=True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "failed_rules", "kept")


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words inside runs of ``run`` words that are found twice or more, the first included.

    Runs are compared by 64-bit hashes within one document.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = let(
            starts, lambda s: F.transform(s, lambda x, j: F.least(F.lit(run), F.coalesce(F.get(s, j + 1) - x, F.lit(run))))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    unless_distinct = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return let(let(words, lambda w: windows_hash(w, run)), unless_distinct)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed`` and the struct ``__values`` of whole-number values."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = without(docs, *ADDED).withColumn(
        "__m",
        let(
            word_list(t),
            lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words")),
        ),
    )
    out = out.withColumn(
        "__l", let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    out = out.withColumns(
        {
            "n_words": F.col("__m.n_words"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.col("__l.n") - F.col("__l.distinct")).cast("bigint"),
            "n_repeat_words": F.col("__m.n_repeat_words"),
            "__upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint"),
            "__marks": F.regexp_count(t, F.lit(MARK)).cast("bigint"),
        }
    )
    return (
        out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
        .withColumn(
            "__values",
            F.when(
                n > 0,
                F.struct(
                    F.expr("__marks * 10000 div n_words").alias("symbols"),
                    F.expr("n_dup_lines * 10000 div __l.n").alias("dup_lines"),
                    F.expr("n_repeat_words * 10000 div n_words").alias("repeats"),
                    F.expr("__upper * 10000 div word_chars").alias("capitals"),
                    F.expr("word_chars * 10000 div n_words").alias("word_length"),
                ),
            ),
        )
        .drop("__m", "__l", "__upper", "__marks")
    )


def sketch(measured: DataFrame, *by: str) -> DataFrame:
    """Mergeable sketch: (by…, rule, bucket, n). Adding the ``n`` of two sketches merges them."""
    pairs = F.array(*[F.struct(F.lit(v).alias("rule"), F.col(f"__values.{v}").alias("value")) for v in VALUES])
    return (
        measured.where(~F.col("base_failed"))
        .select(*by, F.inline(pairs))
        .withColumn("__low", F.expr(f"greatest(length(bin(value)) - {BITS}, 0)"))
        .groupBy(*by, "rule", F.expr("shiftleft(shiftright(value, __low), __low)").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _of_rule(of: Callable[[Rule], object]) -> Column:
    """A setting of the rule that a row names; null where it is not set."""
    return F.coalesce(*[F.when(F.col("rule") == name, F.lit(of(rule))) for name, rule in VALUES.items()])


def fences(sketched: DataFrame, *by: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """(by…, rule, low, high) from the quartiles of a sketch; a group has a bounded number of buckets."""
    group = [*by, "rule"]
    counts = F.when(_of_rule(lambda r: r.shown) & (F.col("bucket") == 0), F.lit(0)).otherwise(F.col("n"))
    merged = sketched.groupBy(*group, "bucket").agg(F.sum(counts).alias("n"))
    every = Window.partitionBy(*group)
    run = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = merged.select(*group, "bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(every).alias("total"))

    def quartile(q: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))

    out = counted.groupBy(*group).agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.expr(f"q3 div {LEAST_SPREAD}"))
    beyond, enough = _of_rule(lambda r: r.reach) * spread, F.col("total") >= min_rows
    return out.select(
        *group,
        F.when(enough & _of_rule(lambda r: r.both), F.col("q1") - beyond).alias("low"),
        F.when(enough, F.col("q3") + beyond).alias("high"),
    )


def limits(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source with the struct of ``low``/``high`` of every value."""
    keyed = measured.withColumns({"__lang": group_key(lang), "__group": group_key(lang, source)})
    own = cut_lineage(sketch(keyed, "__lang", "__group"), "quality-sketch")
    of_group, of_lang = fences(own, "__lang", "__group"), fences(own, "__lang")
    both = of_group.join(of_lang.withColumnsRenamed({"low": "llow", "high": "lhigh"}), ["__lang", "rule"]).select(
        "__group",
        "rule",
        F.least("low", "llow").alias("low"),
        F.greatest("high", "lhigh", _of_rule(lambda r: r.floor)).alias("high"),
    )
    wide = both.groupBy("__group").agg(
        *[F.max(F.when(F.col("rule") == v, F.struct("low", "high"))).alias(f"__{v}") for v in VALUES]
    )
    # Written so that Spark knows its size before it plans the join with the documents.
    return cut_lineage(wide, "quality-limits")


def judge(measured: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the limits and add ``failed_rules`` and ``kept``."""
    joined = measured.withColumn("__group", group_key(lang, source)).join(bounds, "__group", "left")
    failed = F.filter(
        F.array(
            *[
                F.when(
                    (F.col(f"__values.{v}") > F.col(f"__{v}.high")) | (F.col(f"__values.{v}") < F.col(f"__{v}.low")), F.lit(v)
                )
                for v in VALUES
            ]
        ),
        lambda r: r.isNotNull(),
    )
    out = joined.withColumn("failed_rules", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("__group", "__values", *[f"__{v}" for v in VALUES])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with their counts and verdict.

    The measured rows are written once, since sketches and verdicts both read them; ``keep`` names
    the input columns to carry (all if not given).
    """
    measured = measure(docs, text)
    if keep is not None:
        measured = measured.select(*keep, *COUNTS, "base_failed", "__values")
    measured = cut_lineage(measured, "quality-measured")
    return judge(measured, limits(measured, lang, source), lang, source)
