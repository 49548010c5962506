"""Mixing sources to target weights by capped water-filling.

The size of a source is the words of its documents. All sources share a total in proportion to
their weights; no source may be repeated more than ``max_epochs`` times. Sources above that are
clamped and their excess is shared by weight among the others until none is above. A document is
taken ``floor(target / size)`` times whole; the fraction that remains is taken from the documents
of the source in seeded order, up to the document whose middle passes it, so the words taken are
within half a document of the target. Only DataFrame functions are used.

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources
without words get target 0 and nothing is taken from them; repeated rows are documents of their
own; an empty table gives an empty mix. Columns of the input that clash with the added ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import group_key, text_of, without, word_count
from corpusloom.operators.order import with_row_index
from corpusloom.session import cut_lineage

ADDED = ("size", "source_size", "target", "copies", "taken")
SLICE_DIGITS = 3  # hex digits of the draw that name one of 4,096 slices of a source


def cycle_weights(sizes: DataFrame, source: str = "source", cycle: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: the values of ``cycle`` in turn over the sources by code point, null last."""
    order = [F.col(source).isNull().cast("int"), F.coalesce(F.col(source).cast("string"), F.lit(""))]
    ranked = with_row_index(sizes, order, "__rank")
    turn = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.withColumn("weight", F.get(turn, (F.col("__rank") % len(cycle)).cast("int"))).drop("__rank")


def fill(sizes: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """Add ``target`` to a table of (source_size, weight).

    Each turn clamps the sources whose share exceeds their cap and spreads what is left; the
    level only rises, so a clamped source stays clamped. Two sums reach the driver per turn.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = cap < F.col("weight") * level
        row = sizes.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap)).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not row.free or row.n == clamped:
            break
        clamped = row.n
        level = max(0.0, (row.total * share - (row.capped or 0.0)) / row.free)
    return sizes.withColumn("target", F.least(cap, F.col("weight") * level))


def mix(
    docs: DataFrame,
    weigh=cycle_weights,
    size: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words, repeats counted).

    ``size`` is the number of words, counted from ``text`` if not given. ``weigh`` adds ``weight``
    to a table of (source, source_size). The total shared is ``share`` of all words. The order in
    a source is md5(key, seed); ``key`` should be unique.
    """
    docs = without(docs, *ADDED)
    words = word_count(text_of("text")) if size is None else F.coalesce(size, F.lit(0)).cast("bigint")
    draw = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(str(seed))))
    drawn = docs.withColumns({"__draw": draw, "__source": group_key(source)})
    drawn = drawn.withColumn("__slice", F.substring("__draw", 1, SLICE_DIGITS))
    # Words per source and slice of the draw; the partial sums run before the shuffle.
    slices = drawn.groupBy("__source", "__slice").agg(F.first(source).alias(source), F.sum(words).alias("slice_size"))
    slices = cut_lineage(slices, "mix-slices")
    sizes = slices.groupBy("__source").agg(F.first(source).alias(source), F.sum("slice_size").alias("source_size"))
    targets = fill(cut_lineage(weigh(cut_lineage(sizes, "mix-sizes"), source), "mix-weights"), max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select("__source", "source_size", "target", whole.alias("__whole"))
    targets = targets.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    # The slice in which the running sum passes the rest: those before it are taken, those after not.
    run = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = F.when(F.col("__upto") >= F.col("__rest"), F.struct("__slice", "__upto", "slice_size"))
    border = (
        slices.select("__source", "__slice", "slice_size", F.sum("slice_size").over(run).alias("__upto"))
        .join(targets, "__source")
        .groupBy("__source", "source_size", "target", "__whole", "__rest")
        .agg(F.min(passed).alias("__b"))
        .withColumns({"__cut": F.col("__b.__slice"), "__before": F.col("__b.__upto") - F.col("__b.slice_size")})
        .drop("__b")
    )
    border = cut_lineage(border, "mix-border")
    # In that slice alone the documents are put in order, to find the last one taken. Spark
    # broadcasts the small tables if their files are small enough and splits a hot source otherwise.
    at_cut = drawn.join(border, "__source").where(F.col("__slice") == F.col("__cut")).withColumn("__n", words)
    ahead = Window.partitionBy("__source").orderBy("__draw", "__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("__before") + F.sum("__n").over(ahead)) - F.col("__n")
    last = (
        at_cut.select("__source", "__draw", "__n", "__rest", middle.alias("__middle"))
        .where(F.col("__middle") <= 2 * F.col("__rest"))
        .groupBy("__source")
        .agg(F.max(F.struct("__draw", "__n", "__middle")).alias("__last"))
    )
    limits = cut_lineage(border.join(last, "__source", "left"), "mix-limits")
    out = drawn.withColumn("size", words).join(limits, "__source")
    in_slice = (F.col("__slice") == F.col("__cut")) & (F.struct("__draw", "size") <= F.struct("__last.__draw", "__last.__n"))
    more = F.coalesce((F.col("__slice") < F.col("__cut")) | in_slice, F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("__whole").cast("int") + more.cast("int")).otherwise(F.lit(0))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def repeat_rows(mixed: DataFrame, copies: str | Column = "copies") -> DataFrame:
    """The mix as rows: every document as often as it is taken."""
    n = F.col(copies) if isinstance(copies, str) else copies
    return mixed.where(n > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy")
