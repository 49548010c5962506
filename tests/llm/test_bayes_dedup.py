import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import bayes_dedup, shingles as hashed

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    """Components by comparing every two documents."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                comp[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    least = {r: min((x for x in known if x is not None), default=None) for r, known in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def found(spark, rows, schema=SCHEMA, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    return sorted(map(tuple, bayes_dedup.near_copies(df).collect()), key=repr)


def families(rng, n, low=1, high=80):
    """Texts with copies that differ in a few words, at similarities around the threshold, and chains of them."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        text = rng.choices(words, k=rng.randint(low, high))
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(text)))
            if rng.random() < 0.5:
                text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = families(random.Random(seed), 160)
    assert found(spark, rows) == plain(rows)


def test_outsiders_of_a_large_bucket_are_compared_in_blocks(spark, monkeypatch):
    """The chain's members share buckets with many others but are linked to some of them only."""
    monkeypatch.setattr(bayes_dedup, "BLOCK", 4)
    monkeypatch.setattr(bayes_dedup, "PAIRS_PER_HUB", 3)
    rng = random.Random(7)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(70):
        text = list(base)
        for j in range(i % 7):
            text[(i * 5 + j * 9) % 60] = f"n{i}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (None, "a b c d"), (8, "a b c d")]
    rows += [(9, "é É"), (10, "É É"), (8, "a b c d"), (None, "lonely words without id"), (11, "x " * 4000), (12, "x x x")]
    got = bayes_dedup.near_copies(spark.createDataFrame([(*r, "c", 1, "k") for r in rows], SCHEMA + ", component_id string, n_shingles int, key string"))
    got = sorted(map(tuple, got.collect()), key=repr)
    want = sorted(((d, n, c if n else d, (c if n else d) == d) for d, n, c, _ in plain(rows)), key=repr)
    assert got == want
    assert bayes_dedup.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"wörd{i % 700}" * (1 + i % 3) for i in range(3_000))
    whole = hashed.hashes_of_words(text.encode(), hashed.SIGNS)
    monkeypatch.setattr(hashed, "PART", 257)
    assert (hashed.hashes_of_words(text.encode(), hashed.SIGNS) == whole).all()
    cased, low = (list(hashed.words_of(pa.array(["Ab aB ab"]), lower)) for lower in (False, True))
    assert len(set(cased[0])) == 3 and len(set(low[0])) == 1
    texts = pa.array(["", text, "a b", " ", "A  B", text[:300], "c"])
    for slice_ in (texts, texts[1:]):
        sets = list(bayes_dedup.sets_of(slice_, 3))
        assert [len(s) for s in sets] == [len(shingles(t)) for t in slice_.to_pylist()]
    assert (sets[1] == sets[3]).all()


def test_posterior_bounds():
    """The bound is the least m whose posterior still gives the threshold the chosen chance."""
    for n, least in bayes_dedup.least_matches(Fraction(85, 100), 1e-6):
        s = (np.arange(200_000) + 0.5) / 200_000
        for m, alive in ((least, True), (least - 1, False)):
            if m >= 0:
                density = np.exp(m * np.log(s) + (n - m) * np.log1p(-s) - (n * np.log(0.85)))
                assert (density[s >= 0.85].sum() / density.sum() >= 1e-6) == alive


def test_links_are_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert list(bayes_dedup.exactly([a, a, a], [a[:85], a[:84], a[15:]], Fraction(85, 100))) == [True, False, True]


def test_every_signature_value_tells_the_similarity():
    rng = np.random.default_rng(6)
    hits = np.zeros(bayes_dedup.BANDS * bayes_dedup.ROWS)
    for _ in range(150):
        pool = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = bayes_dedup.as_labels(pa.array([bayes_dedup.signature(np.sort(pool[:100])), bayes_dedup.signature(np.sort(pool[20:]))]))
        hits += a == b
    assert abs(hits.mean() / 150 - 2 / 3) < 0.02
