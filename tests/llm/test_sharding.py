import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding


def rows(n, seed=1):
    rnd = random.Random(seed)
    out = [(i, "x" * rnd.randrange(200) + str(i), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None])) for i in range(n)]
    return out + [(n + i, "copy of a text", "en", "a" if i % 2 else "b") for i in range(n // 30)] + [(None, None, None, None), (0, out[0][1] if n else "", "en", "a")]


def check(out, given, shards, near):
    assert len(out) == len(given)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((repr(k), size(t), zlib.crc32((t or "").encode())) for k, t, _, _ in given)
    slots, weight = {}, dict.fromkeys(range(shards), 0)
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        weight[r.shard] += r.size
    assert set(weight) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(weight.values()) / shards
    assert max(abs(w - mean) for w in weight.values()) <= near * mean


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_near_equal_bytes(spark, shards):
    given = rows(6_000)
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string").withColumns({"shard": F.lit("old"), "node": F.lit(1)})
    out = sharding.shard_documents(df.repartition(4), shards=shards).collect()
    check(out, given, shards, 0.07)
    # Equal texts stay together unless a border runs through a group of more than the tolerance.
    by_text, texts = {}, {k: t for k, t, _, _ in given if k}
    for r in out:
        if r.doc_id:
            by_text.setdefault(texts[r.doc_id], []).append(r)
    light = 2 * sharding.TOLERANCE * sum(r.size for r in out) / shards
    assert all(len({r.shard for r in g}) == 1 for g in by_text.values() if sum(r.size for r in g) <= light)


def test_a_hot_text_is_divided(spark):
    given = rows(2_000, 3) + [(10_000 + i, "hot " * 30, "en", "a") for i in range(1_500)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(df, shards=8).collect()
    check(out, given, 8, 0.1)
    assert len({r.shard for r in out if r.doc_id and r.doc_id >= 10_000}) > 1


def test_target_bytes_and_layout(spark):
    df = spark.createDataFrame(rows(500), "doc_id long, text string, lang string, source string")
    one = sharding.shard_documents(df.repartition(1), target_bytes=10_000)
    two = sharding.shard_documents(df.repartition(6), target_bytes=10_000)
    as_set = lambda d: sorted(((r.doc_id, r.shard) for r in d.collect()), key=repr)
    assert as_set(one) == as_set(two) and one.select("shard").distinct().count() > 3
    with pytest.raises(ValueError):
        sharding.shard_documents(df)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert sharding.shard_documents(df, shards=24).count() == 0
