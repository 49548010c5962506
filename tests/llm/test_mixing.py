import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def brute_targets(sizes, weights, epochs=3.0):
    """Water level by fixing the fullest sources one after another."""
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while left:
        weight = sum(weights[i] for i in left)
        over = {i for i in left if epochs * sizes[i] < total * weights[i] / weight}
        for i in over or left:
            target[i] = min(epochs * sizes[i], total * weights[i] / weight)
        if not over:
            break
        total -= sum(target[i] for i in over)
        left -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_filling(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 7, 90, 4_000, 50_000]) for _ in range(23)]
    weights = [float(rnd.randrange(1, 9)) for _ in sizes]
    df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, source_size long, weight double")
    got = {r.i: r.target for r in mixing.fill(df, 3.0, 1.0).collect()}
    assert [got[i] for i in range(len(sizes))] == pytest.approx(brute_targets(sizes, weights))
    assert sum(got.values()) == pytest.approx(sum(sizes))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_mix_of_a_hot_source(spark):
    rnd = random.Random(7)
    rows = [(i, "w " * rnd.randrange(1, 40), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3_000)]
    rows += [(None, "a b", "hot"), (None, None, "hot"), (5_000, "", None), (5_001, "x y z", None), (7, "w", "s1"), (7, "w", "s1")]
    df = docs(spark, rows).withColumns({"size": F.lit("old"), "target": F.lit(1), "__n": F.lit(2), "__rest": F.lit(3)})
    out = mixing.mix(df.drop("__n", "__rest")).cache()
    again = mixing.mix(df.drop("__n", "__rest").repartition(2))
    by = lambda d: sorted(((r.doc_id, r.text, r.source, r.taken) for r in d.collect()), key=repr)
    assert by(out) == by(again) and out.count() == len(rows)
    for r in out.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m"), F.sum("size").alias("s")).collect():
        assert r.s == r.source_size and r.target <= 3 * r.source_size + 1e-6
        assert abs(r.t - r.target) <= r.m
    assert out.where("taken > 3 * size").count() == 0
    assert mixing.repeat_rows(out).count() == out.agg(F.sum("copies")).first()[0]


def test_weights_follow_code_points_and_null_is_last(spark):
    df = spark.createDataFrame([(s, 1) for s in ["b", None, "", "é", "Z", "😀"]], "source string, source_size long")
    got = {r.source: r.weight for r in mixing.cycle_weights(df).collect()}
    assert got == {"": 1.0, "Z": 2.0, "b": 3.0, "é": 1.0, "😀": 2.0, None: 3.0}


def test_nothing_to_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    (r,) = mixing.mix(docs(spark, [(1, None, None)])).collect()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
