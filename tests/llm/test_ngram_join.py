import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join as j
from corpusloom.llm.catalog import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=5, threshold=0.8):
    """{position: (class_id, copies, links)} by comparing all pairs that share an n-gram."""
    words = [tuple(WORD.findall(t or "")) for _, t in rows]
    sets = [{w[i : i + n] for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram, links, copies = {}, [0] * len(rows), [0] * len(rows)
    for i, s in enumerate(sets):
        near = set().union(*(by_gram.get(g, ()) for g in s)) if s else {k for k in range(i) if not words[k]}
        for k in near:
            both = len(s & sets[k])
            if words[i] == words[k] or (s and both >= threshold * (len(s) + len(sets[k]) - both) - 1e-9):
                links[i] += 1
                links[k] += 1
                parent[max(top(i), top(k))] = min(top(i), top(k))
            if words[i] == words[k]:
                copies[i] += 1
                copies[k] += 1
        for g in s:
            by_gram.setdefault(g, set()).add(i)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[top(i)] = min(key, ids.get(top(i), key))
    return sorted(((rows[i][0], ids.get(top(i)), copies[i] + 1, links[i]) for i in range(len(rows))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in j.jaccard_classes(df).collect()), key=repr)


def near_copies(seed=1, groups=12, size=9):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([6, 30, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(5)}"
            rows.append((len(rows) * 3, " ".join(w)))
    return rows


def test_prefix_length_reaches_the_recall():
    k = j.prefix_length(0.8)
    assert 1 - (1 - 0.8**k) ** j.TREES >= j.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** j.TREES


def signed(spark, sequences):
    rows = [(f"{i:04d}".encode(), bytearray(np.asarray(s, ">u2").tobytes())) for i, s in enumerate(sequences)]
    return spark.createDataFrame(rows, "key binary, labels binary")


def test_the_prefix_shrinks_until_sampled_pairs_meet(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 16, j.TREES * j.DEPTH)
    other = base.copy()
    other[4 :: j.DEPTH] ^= 1  # similar (7 of 8 labels), but no tree agrees beyond its fourth label
    far = rnd.integers(0, 1 << 16, j.TREES * j.DEPTH)
    df = signed(spark, [base, other, far])
    assert j.met_by_depth(df, 0.8) == [2, 2, 2, 2, 2, 0, 0, 0, 0]
    assert j.adapted_length(df, 0.8) == 4 < j.prefix_length(0.8)
    assert j.adapted_length(signed(spark, [base, base, far]), 0.8) == j.prefix_length(0.8)
    assert j.met_by_depth(df.limit(0), 0.8) == [0] * 9 and j.adapted_length(df.limit(0), 0.8) == j.prefix_length(0.8)


@pytest.mark.parametrize("rows", [512, 3])
def test_the_prefix_follows_every_similar_pair(spark, monkeypatch, rows):
    monkeypatch.setattr(j, "BLOCK_ROWS", rows)
    rnd = np.random.default_rng(6)
    sequences = [s for s in rnd.integers(0, 1 << 16, (150, j.TREES * j.DEPTH)) for _ in range(2)]
    odd = sequences[40].copy()
    odd[4 :: j.DEPTH] ^= 1  # one pair of 150 that no tree brings together beyond its fourth label
    sequences[41] = odd
    sequences += [sequences[0]] * 6  # a class of eight: 56 ordered pairs instead of 2
    df = signed(spark, sequences).repartition(3)
    assert j.met_by_depth(df, 0.8) == [354] * 5 + [352] * 4
    assert j.adapted_length(df, 0.8) == 4


@pytest.mark.parametrize("depth", [1, 3])
def test_ties_connect_what_shares_a_prefix(spark, depth):
    rnd = random.Random(4)
    sequences = [[rnd.randrange(3) if i % j.DEPTH < 3 and i < 24 else rnd.randrange(1 << 16) for i in range(j.TREES * j.DEPTH)] for _ in range(60)]
    sequences += [[70_00 + i % 9 for i in range(j.TREES * j.DEPTH)]] * 40  # one node over several ranges
    parent = list(range(100))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t in range(j.TREES):
        first = {}
        for i, s in enumerate(sequences):
            k = first.setdefault(tuple(s[t * j.DEPTH : t * j.DEPTH + depth]), i)
            parent[max(top(i), top(k))] = min(top(i), top(k))
    found = {int(bytes(r.key)): int(bytes(r.cluster)) for r in j.candidates(signed(spark, sequences), depth).collect()}
    groups = [top(i) for i in range(100)]
    assert found == {i: g for i, g in enumerate(groups) if groups.count(g) > 1}


def test_runs_go_on_over_batches():
    rows = [(0, b"aa", b"1"), (0, b"aa", b"2"), (0, b"aa", b"3"), (0, b"ab", b"4"), (1, b"ab", b"5"), (1, b"ab", b"6")]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), [pa.int8(), pa.binary(), pa.binary()])], ["tree", "node", "key"])
    for cut in range(1, 6):
        got = [tuple(r.values()) for b in j.runs(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        assert [r[:2] for r in got if r[1]] == [(b"2", b"1"), (b"3", b"1"), (b"6", b"5")]
        assert [r for r in got if not r[1]] == [(b"1", None, 0, b"aa"), (b"6", None, 1, b"ab")]
    assert list(j.runs(iter([]))) == []


def test_against_brute_force(spark):
    rows = near_copies() + [(None, "a b c"), (None, "a  b\tc"), (1, ""), (2, None), (4, " \n"), (5, "one"), (5, "one"), (7, "x " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("labels", F.lit(2)).repartition(3)
    assert got(df) == brute(rows)


@pytest.mark.parametrize("size", [1, 4])
def test_small_blocks_give_the_same(spark, monkeypatch, size):
    monkeypatch.setattr(j, "BLOCK_ROWS", size)
    rows = near_copies(2, 4, 14)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("most", [1 << 15, 1 << 17])
def test_the_bitmap_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(j, "MOST_BITS", most)
    wanted = spark.range(0, 9_000, 3).select(F.col("id").alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    rows = spark.range(9_000).select(F.col("id").alias("a"), F.concat(F.lit("k"), "id").alias("b"), F.lit("x").alias("c"))
    kept = {r.a for r in j.maybe_among(rows, wanted, ["a", "b"]).collect()}
    assert set(range(0, 9_000, 3)) <= kept and len(kept) < 4_500
    assert j.maybe_among(rows, wanted.limit(0), ["a", "b"]).count() == 0


def test_one_of_each(spark):
    rows = near_copies(3, 6, 5) + [(0, near_copies(3, 6, 5)[0][1]), (None, "lone words here"), (50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("clash"))
    left = j.one_of_each(df.drop("__text")).collect()
    want = {c for _, c, _, _ in brute(rows)}
    assert sorted((r.doc_id for r in left), key=repr) == sorted(want, key=repr)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(9, 9)]
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    found = {r.id: r.label for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: top(v) for v in parent}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_classes(df).count() == 0 and j.one_of_each(df).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op1_ngram_join"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in rows), key=repr) == brute(docs)
