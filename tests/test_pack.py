import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.order import with_row_index
from corpusloom.operators.pack import pack, resolve_block_size


def model(rows, block, batch_rows, keep_short):
    """Plain restatement of the rule: join a batch, cut it, drop the rest."""
    out = []
    step = batch_rows or max(1, len(rows))
    for b in range(0, len(rows), step):
        joined = [t for row in rows[b : b + step] for t in row]
        whole = len(joined) // block * block
        if whole == 0 and keep_short:
            whole = len(joined)
        out += [joined[i : min(i + block, whole)] for i in range(0, whole, block)]
    return out


def packed(spark, rows, block, batch_rows, keep_short, **options):
    df = spark.createDataFrame([(i, r, [x * 2 for x in r]) for i, r in enumerate(rows)], "row_idx long, input_ids array<int>, twice array<int>")
    out = pack(df.repartition(3), block, batch_rows, keep_short=keep_short, **options).collect()
    by = ("batch_id", "block_id") if batch_rows else ("block_id",)
    out.sort(key=lambda r: tuple(r[c] for c in by))
    for r in out:
        assert r.labels == r.input_ids and r.twice == [x * 2 for x in r.input_ids]
    return [r.input_ids for r in out]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("keep_short", [True, False])
def test_random_rows(spark, seed, keep_short):
    rnd = random.Random(seed)
    rows = [[rnd.randrange(99) for _ in range(rnd.choice([0, 1, 3, 8, 40]))] for _ in range(rnd.randrange(1, 40))]
    block, batch = rnd.randrange(1, 12), rnd.choice([1, 5, 1000, None])
    assert packed(spark, rows, block, batch, keep_short) == model(rows, block, batch, keep_short)


@pytest.mark.parametrize("total", [0, 1, 3, 4, 5, 17])
@pytest.mark.parametrize("keep_short", [True, False])
def test_borders(spark, total, keep_short):
    assert packed(spark, [list(range(total))], 4, 1000, keep_short) == model([list(range(total))], 4, 1000, keep_short)


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_batch_border(spark, n):
    rows = [[i] for i in range(n)]
    assert packed(spark, rows, 7, 1000, True) == model(rows, 7, 1000, True)


def test_aligned_ranges_save_the_shuffle_and_change_nothing(spark):
    rows = [[i] * (i % 5) for i in range(400)]
    df = spark.createDataFrame([(i * 3, r) for i, r in enumerate(rows)], "k long, input_ids array<int>").repartition(3)
    indexed = with_row_index(df, "k", align=10, range_col="rng").drop("k")
    out = pack(indexed, 7, 10, within=("rng",))
    got = [r.input_ids for r in sorted(out.collect(), key=lambda r: (r.batch_id, r.block_id))]
    assert got == model(rows, 7, 10, True)
    plan = pack(indexed, 7, 10, within=("rng",))._jdf.queryExecution().executedPlan().toString()
    # The repartition(3) above and the one by range.
    assert plan.count("Exchange") == 2 and plan.count("Exchange shufflepartitionidpassthrough") == 1


def test_splits_are_packed_apart(spark):
    df = spark.createDataFrame([("a", 0, [1, 2, 3]), ("b", 0, [4, 5, 6])], "split string, row_idx long, input_ids array<int>")
    got = pack(df, 2, within=("split",)).select("split", "input_ids").collect()
    assert sorted((r.split, r.input_ids) for r in got) == [("a", [1, 2]), ("b", [4, 5])]


def test_no_token_is_lost_but_the_rest(spark):
    df = spark.range(3000).select(F.col("id").alias("row_idx"), F.array_repeat(F.col("id").cast("int"), (F.col("id") % 9).cast("int")).alias("input_ids"))
    total = df.agg(F.sum(F.size("input_ids"))).first()[0]
    kept = pack(df, 64).agg(F.sum(F.size("input_ids"))).first()[0]
    rest = df.groupBy(F.expr("row_idx div 1000")).agg((F.sum(F.size("input_ids")) % 64).alias("r")).agg(F.sum("r")).first()[0]
    assert total == kept + rest


def test_block_size():
    assert resolve_block_size(None, 512) == 512
    assert resolve_block_size(None, 4096) == 1024
    assert resolve_block_size(2048, 4096) == 2048
    assert resolve_block_size(2048, 512) == 512
