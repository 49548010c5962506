import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import order


def index_of(df, *keys, **options):
    return {tuple(r[k] for k in keys): r.row_idx for r in order.with_row_index(df, list(keys), **options).collect()}


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_index_follows_the_key(spark, n):
    keys = random.Random(n).sample(range(-10_000, 10_000), n)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert index_of(df, "k", ranges=7) == {(k,): i for i, k in enumerate(sorted(keys))}


def test_strings_structs_and_nulls(spark):
    rows = [(s, i) for i in range(4) for s in ["", "a", "b", "é", "中", "😀", None]]
    df = spark.createDataFrame(rows, "s string, i int")
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert index_of(df, "s", "i", ranges=5) == {r: i for i, r in enumerate(want)}


def test_index_does_not_depend_on_the_layout(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    assert index_of(df.repartition(1), "k", ranges=3) == index_of(df.repartition(11, "k"), "k", ranges=9)


@pytest.mark.parametrize("align", [1, 10, 64])
def test_aligned_groups_stay_in_one_range(spark, align):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(6)
    out = order.with_row_index(df, "k", align=align, range_col="r", ranges=8)
    groups = out.groupBy(F.expr(f"row_idx div {align}")).agg(F.countDistinct("r").alias("d"))
    assert groups.where("d > 1").count() == 0
    assert out.select("r").distinct().count() > 1
    assert sorted(r.row_idx for r in out.collect()) == list(range(1000))


def test_ranges_begin_where_they_may(spark):
    df = spark.range(1000).withColumn("ok", F.col("id") % 7 == 3).repartition(5)
    out = order.with_row_index(df, "id", range_col="r", ranges=8, cut_at=F.col("ok"), extra={"before": F.lag("id")})
    starts = [r for r in out.collect() if r.before is None]
    assert len(starts) > 3 and all(r.ok or r.id == 0 for r in starts)
    assert out.where(F.col("before") != F.col("id") - 1).count() == 0
    with pytest.raises(ValueError):
        order.key_ranges(df, "id", align=2, cut_at=F.col("ok"))


@pytest.mark.parametrize("n", [300, 15_000, 30_000])
def test_alignment_needs_a_unique_key(spark, n):
    """One repeated key is found at every size, here in the last rows, where no cut is near."""
    df = spark.range(n).select(F.least("id", F.lit(n - 2)).alias("k"))
    with pytest.raises(Exception, match="unique"):
        order.with_row_index(df, "k", align=7, range_col="r", ranges=4).collect()
    heavy = spark.range(n).select(F.expr("id div 90").alias("k"))
    with pytest.raises(Exception, match="unique"):
        order.with_row_index(heavy, "k", align=7, range_col="r", ranges=4).collect()


def test_head_with_ties_and_nulls(spark):
    df = spark.range(12_000).select(F.expr("if(id < 3, null, id div 2 * 2)").alias("k"), "id")
    assert order.take_head(df, 3, None, "k").count() == 3
    assert sorted(r.id for r in order.take_head(df, 10_002, None, "k").collect()) == list(range(10_002))
    with pytest.raises(ValueError, match="equal keys"):
        order.take_head(df, 10_003, None, "k")
    assert order.take_head(df, 10_003, None, ["k", "id"]).count() == 10_003


def test_a_key_with_a_third_of_the_rows(spark):
    df = spark.createDataFrame([(5 if i % 3 == 0 else i, i) for i in range(900)], "k int, i int")
    got = index_of(df, "k", "i", ranges=6)
    assert got == {r: n for n, r in enumerate(sorted((5 if i % 3 == 0 else i, i) for i in range(900)))}


def test_present_order_without_a_key(spark):
    df = spark.range(0, 100, 1, 4)
    rows = order.with_row_index(df).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.row_idx)] == list(range(100))


@pytest.mark.parametrize("n,pct", [(0, 5), (10, 0), (10, 100), (10, 5), (30, 5), (50, 5), (70, 5), (200, 1), (1000, 33)])
def test_split_percent_rounds_half_to_even(spark, n, pct):
    df = spark.range(n).withColumnRenamed("id", "row_idx").repartition(3)
    got = {r.row_idx: r.split for r in order.split_percent(df, pct).collect()}
    head = round(n * pct / 100)
    assert got == {i: "validation" if i < head else "train" for i in range(n)}


def test_split_percent_checks_its_argument(spark):
    with pytest.raises(ValueError):
        order.split_percent(spark.range(3), 101, "id")


def test_take_head(spark):
    df = order.split_percent(spark.range(200), 10, "id")
    assert sorted(r.id for r in order.take_head(df, 5, "train", "id").collect()) == [20, 21, 22, 23, 24]
    assert order.take_head(df, 10**6, "validation", "id").count() == 20
    assert order.take_head(df, 0, None, "id").count() == 0
    with pytest.raises(ValueError, match="missing"):
        order.take_head(df, 5, "test", "id")


def test_shuffle_is_a_seeded_permutation(spark):
    df = spark.range(50).withColumnRenamed("id", "row_idx").withColumn("k", F.col("row_idx"))
    first, again = order.shuffle(df, 1, "row_idx"), order.shuffle(df.repartition(7), 1, "row_idx")
    other = order.shuffle(df, 2, "row_idx")
    as_map = lambda d: {r.k: r.row_idx for r in d.collect()}
    assert as_map(first) == as_map(again) != as_map(other)
    assert sorted(as_map(first).values()) == list(range(50))


def test_sample_counts_and_preview(spark):
    df = order.split_percent(spark.range(100), 10, "id")
    got = {r.split: r.samples for r in order.sample_counts(df, {"train": 50, "validation": 50, "test": None}).collect()}
    assert got == {"train": 50, "validation": 10}
    assert [r.id for r in order.preview(df, 2, "id").collect()] == [0, 1]


def test_streams_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    stream = spark.readStream.text(str(tmp_path))
    for call in (lambda: order.split_percent(stream, 5, "value"), lambda: order.take_head(stream, 1, None, "value")):
        with pytest.raises(ValueError, match="stream"):
            call()
