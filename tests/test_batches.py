import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.sequences import Specials, add_special, add_special_pair
from corpusloom.operators import collate, evaluate
from corpusloom.operators.userfn import map_batches
from corpusloom.plans import catalog
from corpusloom.session import cut_lineage

SP = Specials()


def rows(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "row_idx long, input_ids array<int>")


def test_dynamic_pad(spark):
    df = rows(spark, [[5], [5, 6, 7], [5, 6], [5] * 8, [5, 0]])
    out = collate.collate_clm(df, 2, SP).orderBy("row_idx").collect()
    assert [r.mini_batch_id for r in out] == [0, 0, 1, 1, 2]
    assert [r.input_ids for r in out] == [[5, 0, 0], [5, 6, 7], [5, 6] + [0] * 6, [5] * 8, [5, 0]]
    assert out[0].labels == [5, -100, -100] and out[4].labels == [5, -100]


@pytest.mark.parametrize("n,want", [(1, 8), (7, 8), (8, 8), (9, 16)])
def test_pad_to_a_multiple(spark, n, want):
    out = collate.collate_clm(rows(spark, [[5] * n]), 8, SP, multiple_of=8).first()
    assert len(out.input_ids) == want


def masked(spark, df, p=0.15, seed=0):
    df = df.withColumn("special_tokens_mask", F.transform("input_ids", lambda x: x.isin(0, 1, 2, 4).cast("int")))
    return {r.row_idx: (r.input_ids, r.labels) for r in collate.mask_tokens(df, SP, 1000, p, seed).collect()}


def test_masking(spark):
    lists = [[1] + [100 + i] * 200 + [2] for i in range(60)]
    df = rows(spark, lists)
    none, some, every = (masked(spark, df, p) for p in (0.0, 0.15, 1.0))
    assert all(x == lists[i] and set(y) == {-100} for i, (x, y) in none.items())
    assert some == masked(spark, df.repartition(7)) != masked(spark, df, seed=1)
    kinds = {"mask": 0, "same": 0, "other": 0}
    for i, (x, y) in every.items():
        assert x[0] == 1 and x[-1] == 2 and y[0] == y[-1] == -100 and y[1:-1] == lists[i][1:-1]
        for a, b in zip(x[1:-1], y[1:-1]):
            kinds["mask" if a == 4 else "same" if a == b else "other"] += 1
    total = sum(kinds.values())
    assert abs(kinds["mask"] / total - 0.8) < 0.02 and abs(kinds["same"] / total - 0.1) < 0.02
    share = sum(v != -100 for _, y in some.values() for v in y) / total
    assert abs(share - 0.15) < 0.02
    for i, (x, y) in some.items():
        assert all(b == -100 or b == o for o, b in zip(lists[i], y))
        assert all(a == o for a, o, b in zip(x, lists[i], y) if b == -100)


def test_rows_of_specials_are_left_alone(spark):
    x, y = masked(spark, rows(spark, [[1, 2, 0, 4]]), 1.0)[0]
    assert x == [1, 2, 0, 4] and y == [-100] * 4


def test_masked_batches(spark):
    df = rows(spark, [[1, 9, 2], [1, 9, 9, 9, 2]]).withColumn("special_tokens_mask", F.transform("input_ids", lambda x: (x < 5).cast("int")))
    out = collate.collate(df, "masked", 2, SP, 100, p=1.0).orderBy("row_idx").first()
    assert out.labels == [-100, 9, -100, -100, -100] and out.input_ids[3:] == [0, 0]


def test_masking_is_done_before_padding(spark):
    """What pads is never chosen, so it is not gone through for draws."""
    df = rows(spark, [[1, 9, 2]]).withColumn("special_tokens_mask", F.transform("input_ids", lambda x: (x < 5).cast("int")))
    plan = collate.collate(df, "masked", 2, SP, 100, multiple_of=8)._jdf.queryExecution().analyzed().toString().splitlines()
    padded, drawn = (next(i for i, line in enumerate(plan) if part in line) for part in ("array_repeat(", "md5("))
    assert padded < drawn  # the last step stands first


@pytest.mark.parametrize("multiple", [None, 8])
def test_masked_batches_follow_the_digests(spark, multiple):
    lists, keys = [[1] + [50 + i] * n + [2] for i, n in enumerate([0, 40, 3, 25, 11])], [0, 1, 2, 3, None]
    df = spark.createDataFrame(list(zip(keys, lists)), "row_idx long, input_ids array<int>")
    df = df.withColumn("special_tokens_mask", F.transform("input_ids", lambda x: (x < 5).cast("int")))
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    got = {r.row_idx: r for r in collate.collate(df, "masked", 2, SP, 1000, p=0.5, seed=3, multiple_of=multiple).collect()}
    for key, ids in zip(keys, lists):
        longest = max(len(x) for k, x in zip(keys, lists) if (k is None) == (key is None) and (k is None or k // 2 == key // 2))
        size = longest if multiple is None else -(-longest // multiple) * multiple
        want, labels = [], []
        for i, x in enumerate(ids):
            h = hashlib.md5("-".join(str(v) for v in (key, i, 3) if v is not None).encode()).hexdigest()
            first, kind, other = (int(h[a : a + 8], 16) for a in (0, 8, 16))
            chosen = x >= 5 and first / 2**32 < 0.5
            share = kind / 2**32
            want.append(x if not chosen or share >= 0.9 else SP.mask if share < 0.8 else other % 1000)
            labels.append(x if chosen else -100)
        pad = size - len(ids)
        row = got[key]
        assert (row.input_ids, row.labels) == (want + [0] * pad, labels + [-100] * pad)
        assert (row.attention_mask, row.special_tokens_mask[len(ids) :]) == ([1] * len(ids) + [0] * pad, [1] * pad)


def test_masked_query_writes_and_moves_ids_only(spark, tmp_path, monkeypatch):
    """The masks follow from the ids, so they are made where the batches are."""
    spark.createDataFrame([(i, f"a b c{i}\n\nd a") for i in range(40)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    written = {}

    def noted(df, name="stage"):
        written[name] = df.columns
        return cut_lineage(df, name)

    monkeypatch.setattr(catalog, "cut_lineage", noted)
    out = catalog.masked_batches(spark, str(tmp_path), 8).orderBy("row_idx").collect()
    assert written["lines"] == ["doc_id", "line_no", "input_ids"]
    assert len(out) == 80 and out[0].attention_mask == "1 1 1 1 1 0 0 0" and out[1].attention_mask == "1 1 1 1 0 0 0 0"


def test_stacking(spark):
    df = rows(spark, [[1, 2], [3, 4], [5, 6]]).withColumn("labels", F.col("input_ids"))
    out = collate.collate(df.repartition(2), "fixed", 2).orderBy("mini_batch_id").collect()
    assert [r.input_ids for r in out] == [[[1, 2], [3, 4]], [[5, 6]]]
    with pytest.raises(Exception, match="different length"):
        collate.collate_fixed(rows(spark, [[1], [1, 2]]), 2, ["input_ids"]).collect()
    with pytest.raises(KeyError):
        collate.collate(df, "nothing")
    assert collate.collate(df, lambda d, n: d.limit(n), 1).count() == 1


def test_specials(spark):
    r = spark.range(1).select(
        add_special(F.array(F.lit(7)), SP).alias("a"),
        add_special(F.array(F.lit(7)), SP, "prefix").alias("b"),
        add_special_pair(F.array(F.lit(7)), F.array(F.lit(8)), SP).alias("c"),
    ).first()
    assert (r.a, r.b, r.c) == ([1, 7, 2], [7, 4, 1], [7, 4, 1, 8, 2])
    with pytest.raises(ValueError):
        add_special(F.array(F.lit(7)), SP, "other")


def judged(spark, data):
    return spark.createDataFrame(data, "g string, preds array<int>, labels array<int>")


def test_accuracy(spark):
    df = judged(spark, [("a", [1, 2, 3, 9], [9, 1, 2, -100]), ("b", [5], [5])])
    r = evaluate.token_accuracy(df).first()
    assert (r.correct, r.total, r.accuracy) == (2, 3, 2 / 3)
    r = evaluate.token_accuracy(df, ignore=-100).first()
    assert (r.correct, r.total) == (2, 2)
    r = evaluate.token_accuracy(df, shift=False, ignore=-100).first()
    assert (r.correct, r.total, r.accuracy) == (1, 4, 0.25)
    by = {r.g: r.accuracy for r in evaluate.token_accuracy(df, by=["g"]).collect()}
    assert by == {"a": 2 / 3, "b": None}


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([[0.5, 2.0, 2.0], [-1.0, -2.0, -3.0]],)], "logits array<array<double>>")
    assert evaluate.predictions(df).first().preds == [1, 0]
    both = df.select(F.struct("logits", F.lit(1).alias("past")).alias("logits"))
    assert evaluate.predictions(both).first().preds == [1, 0]
    assert evaluate.predictions(df, preprocess=F.size).first().preds == [3, 3]


def test_loss(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([("x", logits, [2, 0, -100]), ("y", logits, [-100] * 3)], "s string, logits array<array<double>>, labels array<int>")
    want = (math.log(sum(math.exp(v) for v in logits[0])) - 3.0) / 2
    got = {r.s: r for r in evaluate.perplexity(evaluate.token_losses(df), ["s"]).collect()}
    assert got["x"].tokens == 2 and abs(got["x"].eval_loss - want) < 1e-12
    assert abs(got["x"].perplexity - math.exp(want)) < 1e-12
    assert got["y"].eval_loss is None and got["y"].perplexity is None
    logp = spark.createDataFrame([([-1000.0, -1000.0], [1, 1])], "lp array<double>, labels array<int>")
    assert evaluate.perplexity(evaluate.token_losses(logp, None, "lp")).first().perplexity == math.inf
    zero = spark.createDataFrame([([0.0], [1])], "lp array<double>, labels array<int>")
    assert evaluate.perplexity(evaluate.token_losses(zero, None, "lp")).first().perplexity == 1.0


def test_user_metrics(spark):
    df = judged(spark, [("a", [1, 2], [1, 3]), ("b", [4], [4])] * 20).repartition(3)

    def partial(batch):
        hits = [p == y for ps, ys in zip(batch.preds, batch.labels) for p, y in zip(ps, ys)]
        return {"hits": sum(hits), "n": len(hits)}

    out = evaluate.batch_metric(df, partial, ["hits", "n"], lambda c: c["hits"] / c["n"], "score")
    assert out.first().score == 2 / 3
    metric = lambda d: evaluate.token_accuracy(d, shift=False)
    assert evaluate.evaluate(df, metric, preprocess=None).first().accuracy == 2 / 3
    table = {r.metric: r.value for r in evaluate.metrics_table(eval=metric(df).select("correct", "accuracy")).collect()}
    assert table == {"eval_correct": 40.0, "eval_accuracy": 2 / 3}


def test_batch_functions(spark):
    df = spark.range(10).withColumn("b", F.expr("id div 4"))
    twice = map_batches(df, lambda cols: {"x": [v for v in cols["id"] for _ in range(2)]}, "x long")
    assert sorted(r.x for r in twice.collect()) == sorted(list(range(10)) * 2)
    sums = map_batches(df, lambda cols: {"s": [sum(cols["id"])]}, "s long", batch_col="b")
    assert sorted(r.s for r in sums.collect()) == [6, 17, 22]


def test_batch_functions_keep_whole_numbers_beside_nulls(spark):
    rows = [(2**60 + 1, None), (None, [1, None]), (7, [])]
    df = spark.createDataFrame(rows, "id long, l array<int>").coalesce(1)
    same = map_batches(df, lambda cols: cols, "id long, l array<int>")
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(rows, key=repr)
    grouped = map_batches(df.withColumn("b", F.lit(1)), lambda cols: {"id": cols["id"]}, "id long", batch_col="b")
    assert sorted((r.id for r in grouped.collect()), key=repr) == sorted((r[0] for r in rows), key=repr)
