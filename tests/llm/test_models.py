import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id, quality_model
from corpusloom.llm.catalog import QUERIES, held_out

DOCS = "doc_id long, text string, lang string"
SAMPLES = {
    "en": "the quick brown fox and that other thing with which they were",
    "de": "der schnelle braune fuchs und die andere sache mit der sie waren",
    "fr": "le renard brun rapide et cette autre chose avec laquelle ils étaient",
    "es": "el rápido zorro marrón y esa otra cosa con la que ellos estaban",
    "pl": "szybki brązowy lis oraz ta druga rzecz z którą oni byli",
    "it": "la veloce volpe marrone e quella altra cosa con cui essi erano",
    "sv": "den snabba bruna räven och den andra saken som de var med",
}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 7, 40])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
    if n > 1:
        assert len({tuple(c) for c in code}) == n
        assert all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))
    if n > 3:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


@pytest.mark.parametrize("langs", [1, 2, 4, 7])
def test_languages(spark, langs):
    rows = [(i, t, name) for i, (name, t) in enumerate(list(SAMPLES.items())[:langs])] * 3 + [(50, None, "en"), (51, "123 !", "en"), (52, "the", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old")).repartition(3)
    model = language_id.fit(df, F.lit(True))
    out = language_id.predict(df, model).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (50, 51):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
        else:
            assert r.lang is None or r.lang_pred == r.lang
            assert 0 <= r.score <= 1


def plain_decoder(rows, code):
    """{text: (language, score, ambiguous)}: bits, losses and decoding number by number."""
    buckets, smooth = language_id.BUCKETS, language_id.SMOOTHING
    names = sorted({lang for _, _, lang in rows if lang is not None})
    counts = {name: Counter() for name in names}
    for _, text, lang in rows:
        if lang is not None:
            counts[lang].update(int(g) for found in language_id.grams(text or "") for g in found)
    size = {name: sum(counts[name].values()) + smooth * buckets for name in names}
    share = lambda name, g: (counts[name][g] + smooth) / size[name]
    sides = [[[n for n, c in zip(names, code[:, b]) if c == side] for side in (1, -1)] for b in range(code.shape[1])]
    odds = lambda b, g: [sum(share(n, g) for n in side) / len(side) for side in sides[b]]
    trust = []
    for b in range(len(sides)):
        both = [odds(b, g) for g in range(buckets)]
        trust.append(sum((yes - no) * math.log(yes / no) for yes, no in both))
    trust = [t / (sum(trust) / len(trust)) for t in trust]
    out = {}
    for _, text, _ in rows:
        found = [int(g) for part in language_id.grams(text or "") for g in part]
        margins = []
        for b in range(len(sides)):
            total = sum(math.log(yes / no) for yes, no in (odds(b, g) for g in found))
            margins.append(total / len(found) * min(len(found), language_id.SHARPNESS) if found else 0.0)
        loss = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(trust, word, margins)) / len(sides) for word in code]
        chance = [math.exp(-x) / sum(math.exp(-y) for y in loss) for x in loss]
        best, second = sorted(chance, reverse=True)[:2]
        out[text] = (names[chance.index(best)], best, best - second < language_id.AMBIGUOUS)
    return out


def test_against_a_plain_decoder(spark):
    rows = [(i, text, name) for i, (name, text) in enumerate(list(SAMPLES.items())[:4])]
    rows += [(10, "the schnelle renard con", None), (11, "q", None), (12, "otra andere autre other", "es")]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    want = plain_decoder(rows, model.code)
    for _, text, _ in rows:
        lang, score, ambiguous = model.predict(text)
        assert (lang, ambiguous) == (want[text][0], want[text][2]) and score == pytest.approx(want[text][1], abs=1e-4)


def test_equal_losses_go_to_the_first_language():
    tied = language_id.Model(["a", "b"], np.array([[1.0], [-1.0]], np.float32), np.zeros((language_id.BUCKETS, 1), np.float32), np.ones(1))
    assert tied.predict("some letters") == ("a", 0.5, True)


def test_long_texts_equal_their_parts():
    whole = "word é " * 200_000
    found = np.concatenate(list(language_id.grams(whole)))
    codes = len(" " + whole.strip() + " ")
    assert len(found) == (codes - 1) + (codes - 2)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], DOCS)
    (r,) = language_id.predict(df, language_id.fit(df, F.lit(True))).collect()
    assert r.lang_pred == "und"
    assert language_id.predict(df.limit(0), language_id.fit(df.limit(0), F.lit(True))).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = QUERIES["op7_language_codes"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.95
    scored = QUERIES["op6_quality_discriminant"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert sum(r.quality == r.predicted for r in kept) / len(kept) > 0.9


def test_held_out_by_checksum(spark):
    import zlib

    ids = [0, 1, 17, -4, 10**12, None]
    got = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids}


def brute_scores(x, labels, rows):
    """Densities with plain inverses and determinants."""
    m = quality_model
    center, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - center) / scale
    covs = [np.cov(z[labels == c].T, bias=True) for c in (0, 1)]
    pooled = sum((labels == c).mean() * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = (1 - m.TO_POOLED) * covs[c] + m.TO_POOLED * pooled
        s = (1 - m.TO_IDENTITY) * s + m.TO_IDENTITY * np.trace(s) / len(s) * np.eye(len(s))
        d = (rows - center) / scale - z[labels == c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    prior = np.log((labels == 1).sum() + 1) - np.log((labels == 0).sum() + 1)
    return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0] + prior) / m.TEMPERATURE, -500, 500)))


def test_discriminant_against_brute_force(spark):
    rng = np.random.default_rng(1)
    d = len(quality_model.STATISTICS)
    labels = np.array([0, 1] * 60)
    x = rng.normal(size=(120, d)) * (1 + labels[:, None]) + 0.7 * labels[:, None]
    rows = [(int(c), [float(v) for v in r]) for c, r in zip(labels, x)]
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (7, rows[0][1])], "quality int, statistics array<double>").repartition(4)
    model = quality_model.fit(df)
    assert model.scores(x) == pytest.approx(brute_scores(x, labels, x), abs=1e-9)
    out = quality_model.predict(df.withColumn("score", F.lit("old")), model).collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in out) and len(out) == 122


def test_statistics_of_odd_texts(spark):
    texts = ["", " ", "\n\n", "a", "\0", "é" * 9, "x " * 100_000, "#|", "A B c 1!", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("statistics", F.lit(1))
    out = quality_model.with_statistics(df).collect()
    assert all(len(r.statistics) == len(quality_model.STATISTICS) and np.isfinite(r.statistics).all() for r in out)


def test_missing_classes(spark):
    one = quality_model.from_sums({})
    assert one.scores(np.zeros((2, len(quality_model.STATISTICS)))) == pytest.approx([0.5, 0.5])
    empty = spark.createDataFrame([], "quality int, statistics array<double>")
    assert quality_model.fit(empty).factors == []
