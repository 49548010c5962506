"""Subword tokenizers against exhaustive search and a public implementation."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.lookup import TableTooLarge, find_ids, find_tokens
from corpusloom.functions.text import words
from corpusloom.operators import subword
from corpusloom.operators.tokenize import decode, encode, roundtrip_report

SIGNS = "abcé"


def random_pieces(rnd, n, sign=""):
    pieces = {"".join(rnd.choices(SIGNS, k=rnd.randint(1, 4))) for _ in range(n)}
    return sorted(pieces | ({sign + p for p in pieces if rnd.random() < 0.6} if sign else set()))


def cuts(word):
    """All segmentations of a word, as lists of (begin, end)."""
    for inner in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(inner) if c], len(word)]
        yield list(zip(at[:-1], at[1:]))


def test_longest_match_against_the_first_of_all_segmentations():
    for seed in range(150):
        rnd = random.Random(seed)
        ids = {p: i for i, p in enumerate(random_pieces(rnd, 8, "##"), 5)}
        match = subword.LongestMatch(ids.items(), 3, 12)
        for _ in range(15):
            word = "".join(rnd.choices(SIGNS + "x", [9, 9, 9, 9, 1], k=rnd.randint(1, 9)))
            want, at = [], 0
            while at < len(word) and want != [3]:
                ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in ids]
                want, at = (want + [ids[("##" if at else "") + word[at : ends[0]]]], ends[0]) if ends else ([3], at)
            assert match(word) == want
    assert match("a" * 13) == [3] and match("") == []


def test_best_scores_against_all_segmentations():
    for seed in range(150):
        rnd = random.Random(seed)
        rows = [(p, i, rnd.randint(-9, -1) * len(p)) for i, p in enumerate(random_pieces(rnd, 8), 5)]
        best = subword.BestScores(rows, 3)
        score = {p: (s, i) for p, i, s in rows}
        worst = min(s for _, _, s in rows) - subword.UNKNOWN_PENALTY
        for _ in range(8):
            word = "".join(rnd.choices(SIGNS + "x", [9, 9, 9, 9, 2], k=rnd.randint(1, 9)))
            found = []
            for cut in cuts(word):
                parts = [word[a:b] for a, b in cut]
                if all(p in score or len(p) == 1 for p in parts):
                    total = sum(score.get(p, (worst, 3))[0] for p in parts)
                    # among equal sums the longest last piece, then the longest one before it
                    found.append((total, [b - a for a, b in reversed(cut)], [score.get(p, (worst, 3))[1] for p in parts]))
            assert best(word) == max(found)[2]


def test_both_agree_with_a_public_implementation(spark):
    from tokenizers import Tokenizer, models

    rnd = random.Random(11)
    plain = ["".join(rnd.choices("abcd", k=rnd.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(plain)], "i int, text string")
    pieces = random.Random(1)
    ids = {"<unk>": 3, **{p: i for i, p in enumerate([*"abcd", *random_pieces(pieces, 12, "##"), "##a", "##b", "##d"], 5)}}
    other = Tokenizer(models.WordPiece(ids, unk_token="<unk>"))
    vocab = spark.createDataFrame([(t, i) for t, i in ids.items() if i != 3], "token string, id int")
    got = encode(df, "text", subword.LongestMatchTokenizer(vocab), attention_mask=False, keep_source=("i",)).collect()
    assert {r.i: r.input_ids for r in got} == {i: other.encode(w).ids for i, w in enumerate(plain)}

    scored = [(p, -float(10 + k * 7 % 13) - k / 64) for k, p in enumerate(dict.fromkeys([*"abcd", *random_pieces(pieces, 20)]))]
    other = Tokenizer(models.Unigram([(p, s) for p, s in scored], None, False))
    vocab = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(scored)], "token string, id int, score double")
    tok = subword.ScoreTokenizer(vocab, split=words)
    got = encode(df, "text", tok, attention_mask=False, keep_source=("i",)).collect()
    assert {r.i: r.input_ids for r in got} == {i: other.encode(w).ids for i, w in enumerate(plain)}


def test_rows_without_words_and_round_trips(spark):
    texts = ["one two  two", "", None, " ", "Ünë \n tab\tend", "x" * 150]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    signs = sorted(set("".join(t or "" for t in texts).lower()) - set(" \n\t"))
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate([*signs, *["##" + s for s in signs], "two"], 5)], "token string, id int")
    tok = subword.LongestMatchTokenizer(vocab)
    got = {r.i: r for r in encode(df, "text", tok, max_length=4, special=True, keep_source=("i",)).collect()}
    assert [len(got[i].input_ids) for i in range(6)] == [4, 2, 2, 2, 4, 3] and got[5].input_ids == [1, 3, 2]
    back = decode(encode(df, "text", tok, keep_source=("i",)), "input_ids", tok).collect()
    assert {r.i: r.text for r in back} == {0: "one two two", 1: "", 2: "", 3: "", 4: "ünë tab end", 5: "<unk>"}
    scores = vocab.where(~F.col("token").startswith("##")).unionByName(spark.createDataFrame([("▁", 900)], "token string, id int"))
    tok = subword.ScoreTokenizer(scores.withColumn("score", F.lit(-1)))
    report = roundtrip_report(df.where("i in (0, 1, 3, 5)"), "text", tok).first()
    assert (report.rows, report.mismatched_rows, report.unknown_tokens) == (4, 0, 0)


def test_size_is_checked_before_the_broadcast(spark):
    vocab = spark.createDataFrame([("abc", 5), ("d", 6)], "token string, id int")
    with pytest.raises(TableTooLarge):
        subword.LongestMatchTokenizer(vocab, max_bytes=20)


def test_candidates_count_every_place(spark):
    df = spark.createDataFrame([("aab aab",), ("b",)], "text string")
    got = {r.token: r.n for r in subword.piece_counts(df, "text", words, 2, "##").collect()}
    assert got == {"a": 2, "aa": 2, "##a": 2, "##ab": 2, "##b": 2, "aab": 2, "b": 1}


def test_places_of_tokens_and_ids():
    tokens = pa.array(["b", None, "x", "b", "a"])
    assert find_tokens(tokens, {"a": 0, "b": 1}).to_pylist() == [1, None, None, 1, 0]
    known, order = np.array([3, 3, 7]), np.array([2, 0, 1])
    assert find_ids(pa.array([7, 4, None, 3, 99], pa.int32()), known, order).to_pylist() == [1, None, None, 2, None]
    assert find_ids(pa.array([7], pa.int32()), np.zeros(0, int), np.zeros(0, int)).to_pylist() == [None]
