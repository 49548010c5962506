import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import winnowing as w

LONG = " ".join(f"w{i % 37}x{i // 5}" for i in range(3_000))
TEXTS = [None, "", " \t", "one", "a b c d", "a b c d e", "the same words the same words the same words the same words", LONG, "中文字中文字中文字中文字中文字", "x" * 100]


def tokens(text):
    wide = "぀-ヿ一-鿿"
    return re.findall(rf"[{wide}]|[^\x20\x09-\x0D{wide}]{{1,24}}", text or "")


def brute(hashes):
    """Least hash of each window, the rightmost on ties, with its place."""
    kept = {}
    for start in range(max(1, len(hashes) - w.WINDOW + 1) if hashes else 0):
        span = range(start, min(start + w.WINDOW, len(hashes)))
        place = min(span, key=lambda i: (hashes[i], -i))
        kept[place] = hashes[place]
    return sorted(kept.items())


def test_prints_match_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: [(p.place, p.hash) for p in r.p] for r in df.select("doc_id", w.fingerprint(F.col("text")).alias("p")).collect()}
    for i, text in enumerate(TEXTS):
        ts = tokens(text)
        grams = [ts] if 0 < len(ts) < w.GRAM else [ts[j : j + w.GRAM] for j in range(max(0, len(ts) - w.GRAM + 1))]
        if not grams:
            assert got[i] == []
            continue
        g = spark.createDataFrame([(n, x) for n, x in enumerate(grams)], "n int, x array<string>")
        hashed = F.xxhash64("x") if len(ts) < w.GRAM else F.xxhash64(*[F.get("x", F.lit(j)) for j in range(w.GRAM)])
        hs = [r.h & (1 << (63 - w.PLACE_BITS)) - 1 for r in g.orderBy("n").select(hashed.alias("h")).collect()]
        assert got[i] == brute(hs), text


def edited(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (key, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        out.append((key, text[: len(text) - cut] + other[:cut]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 3), (40, 4), (700, 7)])
def test_next_document_over_ranges(spark, n, parts):
    rows = [(i * 7, f"text {i} " * (i % 9)) for i in range(n)] + [(None, "no id"), (7, None), (7, "😀 again é" * 3)] * (n > 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("edited", F.lit(1)).withColumn("k0", F.lit("x"))
    out = w.edited_pairs(df)
    assert sorted(((r.doc_id, r.edited) for r in out.collect()), key=repr) == edited(rows)
    assert "k0" in out.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert w.edited_pairs(df).count() == 0


def test_shared_runs_and_likeness(spark):
    shared = " ".join(f"s{i}" for i in range(w.GRAM + w.WINDOW - 1))
    a, b = f"p q r {shared} u v", f"k l {shared} m n o"
    df = spark.createDataFrame([(a, b), (a, a), ("", None), ("", a)], "a string, b string")
    pa, pb = w.fingerprint(F.col("a")), w.fingerprint(F.col("b"))
    near = [r[0] for r in df.select(w.likeness(pa["hash"], pb["hash"])).collect()]
    assert 0 < near[0] < 1 and near[1:] == [1.0, 1.0, 0.0]


def test_query_over_the_table(spark, sf_dir):
    from corpusloom.llm.catalog import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op10_winnowing"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for key, text in edited(docs):
        assert got[key].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
    by_text = {}
    for key, text in docs:
        assert by_text.setdefault(text, got[key].fingerprint) == got[key].fingerprint
        assert got[key].n_chars == len(text or "")
