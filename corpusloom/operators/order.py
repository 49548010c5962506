"""Row order: index, order statistics, head, percentage split, seeded order.

Spark rows have no order, and a window over the whole table would run in one task. Here the sort
key is cut into ranges at fixed key values (a hash sample of the keys). The cut values are
constants in the plan, so a retried or repeated stage puts each row into the same range again.
Rows per range are counted first; the index is the offset of the range plus the position in it.
The counting passes read the key columns only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from corpusloom.functions.draws import digest
from corpusloom.session import cut_lineage

MIN_RANGE_ROWS = 16
SAMPLES_PER_RANGE = 20
HASH_SPAN = 1 << 62
NOT_UNIQUE = "order_by is not a unique key; aligned ranges need one"
TIES = "order_by has equal keys across the border of the head; add a column that tells them apart"

Keys = str | Column | Sequence[str | Column]


def _key_list(order_by: Keys) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(k) if isinstance(k, str) else k for k in items]


def _key(order_by: Keys) -> Column:
    """One comparable value: the column itself or a struct. Nulls come first in both."""
    cols = _key_list(order_by)
    return cols[0] if len(cols) == 1 else F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, dtype.fields)])
    return F.lit(value).cast(dtype)


PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)


def _bounds_array(bounds: list, dtype: T.DataType) -> Column:
    """The cut values as one constant; a text literal where the type allows it, parsed once."""
    fields = dtype.fields if isinstance(dtype, T.StructType) else [T.StructField("v", dtype)]
    if all(isinstance(f.dataType, PLAIN) for f in fields):
        struct = isinstance(dtype, T.StructType)
        values = [dict(zip(dtype.names, b)) if struct else b for b in bounds]
        return F.from_json(F.lit(json.dumps(values)), T.ArrayType(dtype))
    return F.array(*[_literal(b, dtype) for b in bounds])


def _range_of(key: Column, bounds: list, dtype: T.DataType) -> Column:
    """Number of bounds <= key, by binary search in the constant list of bounds."""
    if not bounds:
        return F.lit(0)
    table = _bounds_array(bounds, dtype)
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(len(bounds).bit_length()))])

    def search(key: Column) -> Column:
        return F.aggregate(
            steps, F.lit(0), lambda lo, step: F.when(F.get(table, lo + step - 1) <= key, lo + step).otherwise(lo)
        )

    # A struct is made once per row, not again in every step.
    return F.get(F.transform(F.array(key), search), F.lit(0)) if isinstance(dtype, T.StructType) else search(key)


@dataclass(frozen=True)
class KeyRanges:
    """Cut values of the sort key with the number of rows before each range."""

    order_by: Keys
    dtype: T.DataType
    bounds: list
    offsets: list[int]
    total: int

    def range_col(self) -> Column:
        return _range_of(_key(self.order_by), self.bounds, self.dtype)

    def begins(self) -> Column:
        """Whether the key of a row is the first of a range other than range 0."""
        if not self.bounds:
            return F.lit(False)
        return F.array_contains(_bounds_array(self.bounds, self.dtype), _key(self.order_by))

    def offset_of(self, range_col: Column) -> Column:
        return F.get(F.from_json(F.lit(str(self.offsets)), "array<bigint>"), range_col)

    def locate(self, df: DataFrame, positions: Sequence[int]) -> dict:
        """Keys at the given 0-based positions. Only ranges that hold one are sorted."""
        positions = sorted({p for p in positions if 0 <= p < self.total})
        if not positions:
            return {}
        keys = df.select(_key(self.order_by).alias("key"))
        in_range = _range_of(F.col("key"), self.bounds, self.dtype)
        wanted = sorted({sum(o <= p for o in self.offsets[1:]) for p in positions})
        pos = self.offset_of(F.col("r")) + F.row_number().over(Window.partitionBy("r").orderBy("key")) - 1
        rows = (
            keys.withColumn("r", in_range)
            .where(F.col("r").isin(wanted))
            .withColumn("pos", pos)
            .where(F.col("pos").isin(positions))
            .collect()
        )
        return {r.pos: r.key for r in rows}


def _count_ranges(df: DataFrame, order_by: Keys, bounds: list, dtype: T.DataType) -> list[int]:
    counted = df.select(_range_of(_key(order_by), bounds, dtype).alias("r")).groupBy("r").count().collect()
    sizes = {r["r"]: r["count"] for r in counted}
    offsets, seen = [], 0
    for i in range(len(bounds) + 1):
        offsets.append(seen)
        seen += sizes.get(i, 0)
    return offsets + [seen]


def key_ranges(
    df: DataFrame,
    order_by: Keys,
    align: int | None = None,
    ranges: int | None = None,
    cut_at: Column | None = None,
) -> KeyRanges:
    """Cut the key into ranges of about equal row counts.

    ``ranges`` (``spark.sql.shuffle.partitions`` if not given) bounds what the driver sees:
    ``SAMPLES_PER_RANGE`` keys and one count for each. ``align`` moves every cut to a row position
    that is a multiple of it, so that groups of that many consecutive rows never cross a range.
    That needs a unique key; ``with_row_index`` checks it in every range. ``cut_at`` allows only
    rows it holds for as the first row of a range.
    """
    if align and cut_at is not None:
        raise ValueError("align and cut_at exclude each other")
    spark = df.sparkSession
    first = F.lit(True) if cut_at is None else F.coalesce(cut_at, F.lit(False))
    keys = df.select(_key(order_by).alias("key"), first.alias("first"))
    dtype = keys.schema["key"].dataType
    total = keys.count()
    wanted = ranges or min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // MIN_RANGE_ROWS)
    wanted = max(1, min(wanted, total // max(1, align or 1)))
    # A hash threshold, not sample(): the same keys on every run. Distinct keys only, so a
    # repeated key cannot fill the sample.
    share = min(1.0, SAMPLES_PER_RANGE * wanted / max(1, total))
    picked = keys.where(
        F.col("first") & F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(HASH_SPAN)) < F.lit(int(share * HASH_SPAN)))
    )
    sample = [] if wanted == 1 else [r.key for r in picked.select("key").distinct().orderBy("key").collect()]
    bounds = list(dict.fromkeys(sample[len(sample) * i // wanted] for i in range(1, wanted))) if sample else []
    *offsets, total = _count_ranges(df, order_by, bounds, dtype)
    plan = KeyRanges(order_by, dtype, bounds, offsets, total)
    if not align or not bounds:
        return plan
    found = plan.locate(df, [t for t in {_up(o, align) for o in offsets[1:]} if 0 < t < total])
    bounds = [found[t] for t in sorted(found)]
    if len({repr(b) for b in bounds}) < len(bounds) or any(b is None for b in bounds):
        raise ValueError(NOT_UNIQUE)
    *offsets, total = _count_ranges(df, order_by, bounds, dtype)
    if offsets[1:] != sorted(found):
        raise ValueError(NOT_UNIQUE)
    return KeyRanges(order_by, dtype, bounds, offsets, total)


def _up(position: int, align: int) -> int:
    return -(-position // align) * align


def with_row_index(
    df: DataFrame,
    order_by: Keys | None = None,
    name: str = "row_idx",
    align: int | None = None,
    range_col: str | None = None,
    ranges: int | None = None,
    cut_at: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``.

    The plan below runs for its key columns alone a few times, then once in full. Where the keys
    are not cheap to get (text must be read to filter or to make rows), cut the lineage first.

    Without a key the present order is kept: it is written down once, because a repeated scan may
    split its files differently. ``range_col`` keeps the range number; with ``align`` it lets later
    windows over groups of ``align`` rows reuse the partitioning made here. ``extra`` adds window
    functions evaluated in row order inside a range, such as ``lag``; choose with ``cut_at`` where
    ranges may begin so that they never have to look across.
    """
    drop = []
    if order_by is None:
        df = cut_lineage(df.withColumn("__scan_pos", F.monotonically_increasing_id()), "ordered")
        order_by, drop = "__scan_pos", ["__scan_pos"]
    plan = key_ranges(df, order_by, align, ranges, cut_at)
    r = range_col or "__range"
    in_range = Window.partitionBy(r).orderBy(*_key_list(order_by))
    # One range is one partition: hashing the range number would put several into one.
    out = df.withColumn(r, plan.range_col()).repartitionById(len(plan.bounds) + 1, F.col(r))
    added = {"__pos": F.row_number().over(in_range)} | {c: f.over(in_range) for c, f in (extra or {}).items()}
    if align:
        key = _key(order_by)
        added["__again"] = F.lag(key).over(in_range).eqNullSafe(key) & (F.row_number().over(in_range) > 1)
    out = out.withColumns(added)
    position = plan.offset_of(F.col(r)) + F.col("__pos") - 1
    out = out.withColumn(name, F.when(F.col("__again"), F.raise_error(F.lit(NOT_UNIQUE))).otherwise(position) if align else position)
    return out.drop("__pos", "__again", *drop, *([] if range_col else [r]))


def _below(df: DataFrame, order_by: Keys, n: int) -> Column:
    """Condition that holds for the first ``n`` rows in key order; no row is moved for it.

    Nulls come first. Equal keys on both sides of the border are an error: no condition on the
    key could tell them apart.
    """
    key = _key(order_by)
    if n <= 0:
        return F.lit(False)
    plan = key_ranges(df, order_by)
    if n >= plan.total:
        return F.lit(True)
    border = plan.locate(df, [n - 1])[n - 1]
    inside = key.isNull() if border is None else key.isNull() | (key <= _literal(border, plan.dtype))
    if df.where(inside).count() != n:
        raise ValueError(TIES)
    return inside


def take_head(df: DataFrame, n: int, split: str | None = None, order_by: Keys = "row_idx") -> DataFrame:
    """First ``n`` rows in order, of the named split if one is given; nulls come first.

    Equal keys across the border and a split without rows are errors.
    """
    _batch_only(df, "take_head")
    if split is not None:
        df = df.where(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"split {split!r} is needed but missing")
    return df.where(_below(df, order_by, n))


def in_percent_head(df: DataFrame, pct: int, order_by: Keys = "row_idx") -> Column:
    """Condition of the first ``pct`` percent of the rows, the border rounded half to even.

    A plain comparison with one key value, so filtering by it reaches the scan. Equal keys across
    the border are an error.
    """
    _batch_only(df, "a percentage split")
    if not 0 <= pct <= 100:
        raise ValueError("pct must be between 0 and 100")
    total = df.count()
    head = round(total * pct / 100.0)
    return F.lit(True) if head >= total else _below(df, order_by, head)


def split_percent(df: DataFrame, pct: int, order_by: Keys = "row_idx") -> DataFrame:
    """Add ``split``: the first ``pct`` percent of the rows are validation, the rest train.

    Only the key column is scanned to find the border.
    """
    head = in_percent_head(df, pct, order_by)
    return df.withColumn("split", F.when(head, F.lit("validation")).otherwise(F.lit("train")))


def shuffle(df: DataFrame, seed: int, key: Keys, name: str = "row_idx") -> DataFrame:
    """Seeded order: a new index by ``md5(key, seed)``; the same on every layout of the data."""
    cols = {f"__k{i}": c for i, c in enumerate(_key_list(key))}
    drawn = df.withColumns(cols).withColumn("__draw", digest(*[F.col(c) for c in cols], F.lit(seed)))
    return with_row_index(drawn.drop(name), ["__draw", *cols], name).drop("__draw", *cols)


def preview(df: DataFrame, n: int = 1, order_by: Keys = "row_idx") -> DataFrame:
    """The first rows, to look at."""
    return df.orderBy(*_key_list(order_by)).limit(n)


def sample_counts(df: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """Rows per split, at most the cap of the split."""
    cap = F.lit(None).cast("bigint")
    for split, limit in caps.items():
        if limit is not None:
            cap = F.when(F.col("split") == split, F.lit(limit).cast("bigint")).otherwise(cap)
    return df.groupBy("split").count().select("split", F.least(F.col("count"), cap).alias("samples"))


def _batch_only(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs the number or order of all rows; a stream has neither")
