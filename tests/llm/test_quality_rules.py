import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 8]) for i in range(max(0, len(words) - 7))]
    times = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 50, "# $ % é😀\n#\n#", "same line\nsame line\n same line\n\n", "w " * 40_000]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "the", "é#", "Q|"]) + rnd.choice([" ", "  ", "\n", "\x0b"]) for _ in range(rnd.randrange(80))))
    return out


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").withColumn("kept", F.lit("old"))
    got = {r.doc_id: tuple(r[c] for c in q.COUNTS) for r in q.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts())}


def corpus(spark, groups=(("en", "a"), ("en", "b"), (None, None), ("de", "tiny"))):
    rnd, rows = random.Random(6), []
    for lang, source in groups:
        for i in range(4 if source == "tiny" else 300):
            words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(40)]
            if i % 50 == 7:
                words = [w + "&&&" for w in words]
            rows.append((len(rows), " ".join(words), lang, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_ordinary_documents_stay(spark):
    df = corpus(spark)
    for r in q.quality_rules(df.repartition(3)).collect():
        assert r.kept == ("&&&" not in r.text), r
        assert r.kept == (not r.failed_rules and not r.base_failed)


def test_thresholds_do_not_depend_on_layout_and_sketches_merge(spark):
    measured = q.measure(corpus(spark)).withColumn("__lang", F.coalesce("lang", F.lit("")))
    whole = q.fences(q.sketch(measured, "__lang"), "__lang")
    halves = [q.sketch(measured.where(F.col("doc_id") % 2 == i), "__lang") for i in (0, 1)]
    merged = q.fences(halves[0].unionByName(halves[1]), "__lang")
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))


def test_quartiles_of_the_sketch(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(1, 60) for _ in range(999)]
    rows = [(v, " ".join(["w" * v] * 30)) for v in values]
    df = spark.createDataFrame(rows, "v int, text string").withColumn("g", F.lit("x"))
    measured = q.measure(df).withColumn("base_failed", F.lit(False))
    got = {r.rule: r for r in q.fences(q.sketch(measured, "g"), "g").collect()}["word_length"]
    want = [sorted(values)[len(values) * k // 4] * 10_000 for k in (1, 3)]
    low, high = want[0] - 6 * (want[1] - want[0]), want[1] + 6 * (want[1] - want[0])
    assert abs(got.low - low) <= 0.04 * 13 * want[1] and abs(got.high - high) <= 0.04 * 13 * want[1]


def texts_of_two_sources(rnd):
    """400 documents each; source b repeats more, has more capitals and marks, and words of all lengths."""
    rows = []
    for source, share in (("a", 0.05), ("b", 0.12)):
        for i in range(400):
            size = 5 if source == "a" else rnd.randrange(3, 9)
            words = ["".join(rnd.choice("abcdefgh") for _ in range(size + rnd.randrange(3))) for _ in range(200)]
            words = [w.capitalize() if rnd.random() < share else w for w in words]
            words = [w + "," if rnd.random() < share else w for w in words]
            if i % 4 == 0:
                run = 8 if source == "a" else 12
                words[50 : 50 + run] = words[:run]
            rows.append((" ".join(words) + ("\nx y\nx y" if i % 4 == 1 else ""), source, ""))
    return rows


def test_each_rule_rejects_what_was_made_for_it(spark):
    rnd = random.Random(8)
    rows = texts_of_two_sources(rnd)
    plain = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    made = {
        "symbols": " ".join(w + "%$#!" for w in plain(100)),
        "capitals": " ".join(w.upper() for w in plain(100)),
        "word_length": " ".join("".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(100)),
        "repeats": " ".join((w := plain(100))[:86] + w[:14]),
        "dup_lines": "\n".join(x for w in plain(60) for x in (w, "same")),
    }
    rows += [(text, "a", rule) for rule, text in made.items()]
    df = spark.createDataFrame([(i, "en", *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string, source string, made string")
    out = q.quality_rules(df).collect()
    for r in out:
        assert (r.made in r.failed_rules and not r.kept and not r.base_failed) if r.made else r.kept, r
    limits = {r["__group"]: r for r in q.limits(q.measure(df)).collect()}
    assert len(limits) == 2 and len({str(r["__word_length"]) for r in limits.values()}) == 2
    # a threshold of repeated words that the base rule (30 in 100) does not imply
    assert all(r["__repeats"].high < 2_800 for r in limits.values())


def test_few_rows_take_the_threshold_of_the_language_and_copies_do_not_narrow_it(spark):
    rnd = random.Random(4)
    words = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(k)) for _ in range(60))
    rows = [("xx", "copies", words(5))] * 900 + [("xx", "copies", words(6))] * 20 + [("xx", "few", words(5))] * 3 + [("yy", "few", words(90))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    assert all(r.kept for r in q.quality_rules(df).collect())


def test_clashing_names_empty_and_repeated(spark):
    df = corpus(spark).withColumns({"n_words": F.lit("old"), "low": F.lit(1), "high": F.lit(2), "bucket": F.lit(3), "rule": F.lit("r")})
    twice = df.unionByName(df)
    out = q.quality_rules(twice)
    assert out.count() == twice.count() and {"low", "high", "bucket", "rule"} <= set(out.columns)
    assert q.quality_rules(df.limit(0)).count() == 0
