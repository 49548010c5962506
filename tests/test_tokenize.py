import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lookup
from corpusloom.functions.lookup import TableTooLarge
from corpusloom.functions.sequences import Specials
from corpusloom.functions.text import words
from corpusloom.operators import bpe, tokenize, vocab as vocabulary
from corpusloom.operators.tokenize import (
    BpeTokenizer,
    WordTokenizer,
    byte_level_split,
    decode,
    encode,
    merge_symbols,
    overlength_report,
    roundtrip_report,
)
from corpusloom.plans import catalog, catalog_bpe  # noqa: F401  (registers the queries)
from corpusloom.plans.registry import QUERIES

TEXTS = [
    "the cat sat on the mat.", "the dog, the cat", "", "   ", "zebra _ quagga zebra", "un seul mot",
    "你好 世界 the", "a_b a-b _ __", None, "the " * 50 + "end",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def vocab(docs):
    return vocabulary.word_vocab(docs, "text")


def test_ranked_by_count_then_token(spark, vocab, docs):
    rows = {r.token: r.id for r in vocab.collect()}
    assert rows["the"] == 5 and sorted(rows.values()) == list(range(5, 5 + len(rows)))
    capped = {r.token: r.id for r in vocabulary.word_vocab(docs, "text", 3).collect()}
    assert capped == {t: i for t, i in rows.items() if i < 8}
    big, vocabulary.MAX_RANKED_IN_ONE_TASK = vocabulary.MAX_RANKED_IN_ONE_TASK, 0
    try:
        assert {r.token: r.id for r in vocabulary.word_vocab(docs, "text", 3).collect()} == capped
    finally:
        vocabulary.MAX_RANKED_IN_ONE_TASK = big


@pytest.mark.parametrize("size", [None, 4])
@pytest.mark.parametrize("join,hot", [(False, 0), (True, 3), (True, 0)])
def test_joined_vocabularies_give_the_same(spark, docs, size, join, hot, monkeypatch):
    monkeypatch.setattr(tokenize, "HOT_ENTRIES", hot)
    table = vocabulary.word_vocab(docs, "text", size)
    ids = {r.token: r.id for r in table.collect()}
    tok = WordTokenizer(table, join=join)
    token_lists = {r.i: r.w for r in docs.select("i", F.coalesce(words("text"), F.array().cast("array<string>")).alias("w")).collect()}
    for limit in (None, 3):
        got = {r.i: r.input_ids for r in encode(docs, "text", tok, max_length=limit, keep_source=("i",), key="i").collect()}
        assert got == {i: [ids.get(t, 3) for t in ts[:limit]] for i, ts in token_lists.items()}
    back = decode(encode(docs, "text", tok, keep_source=("i",), key="i"), "input_ids", tok, key="i")
    assert {r.i: r.text for r in back.collect()} == {
        i: " ".join(t if t in ids else "<unk>" for t in ts) for i, ts in token_lists.items()
    }


def test_a_joined_lookup_needs_a_key(docs, vocab):
    with pytest.raises(ValueError, match="key"):
        encode(docs, "text", WordTokenizer(vocab, join=True))


def test_broadcast_tables_are_limited(docs, vocab):
    tok = WordTokenizer(vocab, max_bytes=20)
    for call in (lambda: tok.ids("text"), lambda: decode(docs.select(F.array(F.lit(5)).alias("l")), "l", tok)):
        with pytest.raises(TableTooLarge):
            call()


def test_a_large_vocabulary_with_sparse_ids(spark):
    table = spark.range(100_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") * 7 + 5).cast("int").alias("id"))
    tok = WordTokenizer(table)
    text = "w0 w65531 nothing w65536 w99999"
    ids = encode(spark.createDataFrame([(text,), (None,)], "text string"), "text", tok)
    assert sorted(r.input_ids for r in ids.collect()) == [[], [5, 65531 * 7 + 5, 3, 65536 * 7 + 5, 99999 * 7 + 5]]
    assert sorted(r.text for r in decode(ids, "input_ids", tok).collect()) == ["", text.replace("nothing", "<unk>")]


def test_encode_options(spark, docs, vocab):
    tok = WordTokenizer(vocab)
    row = docs.where("i = 1")

    def run(**o):
        return encode(row, "text", tok, **o).first()

    plain = run().input_ids
    assert len(plain) == 5 and run().attention_mask == [1] * 5
    assert run(max_length=3).input_ids == plain[:3]
    assert run(special=True).input_ids == [1, *plain, 2]
    assert run(special=True, max_length=4).input_ids == [1, *plain[:2], 2]
    assert run(special="prefix").input_ids == [*plain, 4, 1]
    padded = run(special=True, pad_to=9, special_mask=True)
    assert padded.input_ids == [1, *plain, 2, 0, 0]
    assert padded.attention_mask == [1] * 7 + [0, 0]
    assert padded.special_tokens_mask == [1] + [0] * 5 + [1, 1, 1]
    assert run(pad_to=3).input_ids == plain
    assert encode(row, "text", tok, attention_mask=False).columns == ["input_ids"]


def test_reports(spark, docs):
    small = WordTokenizer(vocabulary.word_vocab(docs, "text", 1))
    r = roundtrip_report(docs.where("i in (0, 1)"), "text", small).first()
    assert (r.rows, r.mismatched_rows, r.tokens, r.unknown_tokens) == (2, 2, 12, 8)
    assert r.unknown_rate == round(8 / 12, 6) and r.tokens_per_char == round(12 / 39, 6)
    full = WordTokenizer(vocabulary.word_vocab(docs, "text"))
    assert roundtrip_report(docs.na.drop(), "text", full).first().mismatched_rows == 0
    o = overlength_report(encode(docs, "text", full), 6).first()
    assert (o.rows, o.over_limit, o.longest) == (10, 3, 51)


def test_merge_vocab(spark):
    base = spark.createDataFrame([("a", 0), ("b", 7)], "token string, id int")
    extra = spark.createDataFrame([("x", 3), ("b", 1), ("y", 0), ("z", 9)], "token string, id int")
    got = {r.token: r.id for r in vocabulary.merge_vocab(base, extra).collect()}
    assert got == {"a": 0, "b": 7, "y": 8, "x": 9, "z": 10}
    assert vocabulary.merge_vocab(base, extra.limit(0)).count() == 2
    r = vocabulary.vocab_report(base, vocabulary.merge_vocab(base, extra)).first()
    assert (r.old_size, r.new_size, r.added) == (2, 5, 3)


def test_merge_merges(spark):
    schema = "rank int, left string, right string"
    base = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], schema)
    extra = spark.createDataFrame([(0, "a", "b"), (1, "e", "f")], schema)
    assert sorted(map(tuple, vocabulary.merge_merges(base, extra).collect())) == [
        (0, "a", "b"), (1, "c", "d"), (2, "a", "b"), (3, "e", "f")
    ]
    assert sorted(map(tuple, vocabulary.merge_merges(base, extra, dedupe=True).collect())) == [
        (0, "a", "b"), (1, "c", "d"), (2, "e", "f")
    ]
    with pytest.raises(Exception, match="more than one blank"):
        vocabulary.merge_merges(base, spark.createDataFrame([(0, "a b", "c")], schema)).collect()


# --- merge training against the one-by-one rule ----------------------------------------------------


def naive_bpe(counts, room):
    """One merge at a time: best count, then smallest pair."""
    table = {tuple(w): n for w, n in counts.items()}
    merges, made = [], set()
    while len(made) < room:
        pairs = {}
        for symbols, n in table.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        left, right = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        merges.append((left, right))
        made.add(left + right)
        after = {}
        for symbols, n in table.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == (left, right):
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            after[tuple(out)] = after.get(tuple(out), 0) + n
        table = after
    return merges


@pytest.mark.parametrize("seed", range(2))
def test_rounds_give_the_merges_of_one_by_one_training(spark, seed):
    rnd = random.Random(seed)
    letters = "abcdefgh"[: rnd.choice([2, 4, 8])]
    text = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(60)) for _ in range(3)]
    counts = {}
    for w in " ".join(text).split():
        counts[w] = counts.get(w, 0) + 1
    df = spark.createDataFrame([(t,) for t in text], "text string")
    vocab, merges = bpe.train_bpe(df, "text", max_merges=12)
    got = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == naive_bpe(counts, 12)
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids["<|endoftext|>"] == 0 and sorted(ids.values()) == list(range(len(ids)))
    assert [t for t, _ in sorted(ids.items(), key=lambda e: e[1])][1 : 1 + len(set("".join(counts)))] == sorted(set("".join(counts)))


def test_rounds_on_hot_runs_against_one_by_one_training():
    """Many small random word tables, in plain Python, with few hot pairs: every round continues the naive order."""
    rounds = 0
    for seed in range(400):
        rnd = random.Random(seed)
        letters = "abcd"[: rnd.choice([1, 2, 3, 4])]
        words_ = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 9) for _ in range(14)}
        want = naive_bpe(words_, 25)
        table, done, made = [(list(w), n) for w, n in words_.items()], [], set()
        while len(done) < len(want):
            pairs, rounds = {}, rounds + 1
            for symbols, n in table:
                for p in zip(symbols, symbols[1:]):
                    pairs[p] = pairs.get(p, 0) + n
            ranked = sorted(pairs, key=lambda p: (-pairs[p], p))
            hot = ranked[: rnd.choice([1, 3, 8, 1000])]
            cold = pairs[ranked[len(hot)]] if len(ranked) > len(hot) else 0
            runs = {}
            for symbols, n in table:
                start = 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in hot:
                        if i - start > 1:
                            runs[tuple(symbols[start:i])] = runs.get(tuple(symbols[start:i]), 0) + n
                        start = i
            step = bpe.merges_above(list(runs.items()), ranked[0], cold, 1000, made)
            assert step
            done += step
            for pair in step:
                table = [(bpe.merge_pair(symbols, *pair), n) for symbols, n in table]
        assert done[: len(want)] == want, seed
    assert rounds < 400 * 25


def test_merges_in_order_are_those_of_one_after_the_other():
    for seed in range(200):
        rnd = random.Random(seed)
        merges = [("".join(rnd.choices("ab", k=rnd.randint(1, 2))), "".join(rnd.choices("ab", k=rnd.randint(1, 2)))) for _ in range(8)]
        word = want = rnd.choices("ab", k=12)
        ranks = {}
        for i, pair in enumerate(merges):
            want = bpe.merge_pair(want, *pair)
            ranks.setdefault(pair, []).append(i)
        assert bpe.merge_in_order(word, ranks) == want


@pytest.mark.parametrize("limits", [(3, 1000), (50, 4)])
def test_few_hot_pairs_and_few_runs_change_nothing(spark, limits):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))) for _ in range(200))
    df, counts = spark.createDataFrame([(text,)], "text string"), {}
    for w in text.split():
        counts[w] = counts.get(w, 0) + 1
    _, merges = bpe.train_bpe(df, "text", max_merges=10, max_hot=limits[0], max_runs=limits[1])
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == naive_bpe(counts, 10)


def plain_merges(symbols, ranks):
    """The leftmost merge of the lowest rank, again and again."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_merges_of_a_word_by_heap():
    for seed in range(400):
        rnd = random.Random(seed)
        pool, ranks = ["a", "b", "c"], {}
        for rank in range(rnd.randrange(1, 15)):
            pair = rnd.choice(pool), rnd.choice(pool)
            ranks.setdefault(pair, rank)
            pool.append("".join(pair))
        word = rnd.choices("abcd", [5, 5, 5, 1], k=rnd.randrange(0, 25))
        assert merge_symbols(word, ranks) == plain_merges(word, ranks), seed
    assert merge_symbols(list("ab" * 50_000), {("a", "b"): 0, ("ab", "ab"): 1})[:2] == ["abab", "abab"]


def test_training_stops_without_pairs_and_at_the_size(spark):
    df = spark.createDataFrame([("ab ab a",)], "text string")
    vocab, merges = bpe.train_bpe(df, "text", vocab_size=100)
    assert [tuple(r) for r in merges.collect()] == [(0, "a", "b")]
    assert vocab.count() == 4
    assert bpe.train_bpe(df, "text", vocab_size=3)[1].count() == 0


def test_byte_level_tokenizer_gives_the_text_back(spark):
    texts = ["Hello  world, it's fine\n", "你好中国，好好学习，天天向上", "emoji 😀 é", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    vocab, merges = bpe.train_bpe(df, "text", max_merges=6, split=byte_level_split)
    tok = BpeTokenizer(vocab.withColumn("id", F.col("id") + 5), merges)
    ids = encode(df, "text", tok, keep_source=("i",))
    assert {r.i: r.text for r in decode(ids, "input_ids", tok).collect()} == dict(enumerate(texts))
    assert all(len(r.input_ids) <= len(texts[r.i].encode()) for r in ids.collect())


def test_bpe_ids_agree_with_a_public_implementation(spark):
    from tokenizers import Tokenizer, models

    df = spark.createDataFrame([("low lower lowest new newer newest wide wider",)], "text string")
    vocab, merges = bpe.train_bpe(df, "text", max_merges=12)
    vocab = vocab.withColumn("id", F.col("id") + 5)
    tok = BpeTokenizer(vocab, merges, split=words, byte_level=False)
    ids = {r.token: r.id for r in vocab.collect()}
    other = Tokenizer(models.BPE(ids, [(r.left, r.right) for r in merges.orderBy("rank").collect()]))
    for word in ["lowest", "widest", "new", "wolewer"]:
        got = encode(spark.createDataFrame([(word,)], "text string"), "text", tok).first().input_ids
        assert got == other.encode(word).ids


def test_specials_do_not_overlap():
    sp = Specials()
    assert sp.first_free == 5 and sp.structural == (0, 1, 2, 4) and len(sp.names) == 5


def test_lookups_take_a_batch_in_steps(monkeypatch):
    monkeypatch.setattr(lookup, "STEP", 4)
    lists = pa.array([["a"], [], None, ["b"] * 6, ["a", "c", "b"], ["c"], []])
    for batch in (lists, lists[1:6], lists[:0]):
        parts = list(lookup.steps(iter([batch])))
        assert [v for p in parts for v in p.to_pylist()] == batch.to_pylist()
        assert all(len(p) == 1 or len(lookup.values_of(p)) <= 4 for p in parts)
        back = [v for p in parts for v in lookup.relist(p, lookup.values_of(p)).to_pylist()]
        assert back == batch.to_pylist()
    ids = {"a": [1], "b": [2, 3], "c": []}
    made = list(lookup.words_to_ids(iter([pa.array([["a", "b"], [], ["b", "c", "b"], ["c"]])]), ids.get))
    assert len(made) > 1 and [v for p in made for v in p.to_pylist()] == [[1, 2, 3], [], [2, 3, 2, 3], []]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(lookup, "KEPT_SIGNS", 10)
    made = []
    kept = lookup.Kept(lambda w: made.append(w) or [len(w)])
    assert [kept(w) for w in ("abc", "abc", "d" * 40, "abc", "ef", "abc")] == [[3], [3], [40], [3], [2], [3]]
    assert made == ["abc", "d" * 40, "abc", "ef"] and sum(map(len, kept.found)) <= 10


def test_every_word_of_rows_whose_ids_repeat(spark, tmp_path):
    rows = [(1, "a b c"), (1, "c d"), (None, "b"), (None, None), (2, ""), (2, "e a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkey = pytest.MonkeyPatch()
    with monkey.context() as m:
        m.setattr(tokenize, "HOT_ENTRIES", 2)  # a and b
        m.setattr(lookup, "MAX_BYTES", 60)  # the whole table takes more
        found = QUERIES["encode_words"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, "5 6 7"), (1, "7 8"), (None, "6"), (None, ""), (2, ""), (2, "9 5")], key=repr
    )


def test_a_word_is_looked_at_once_for_its_pairs(spark):
    df = spark.createDataFrame([("ab abc a",), ("ab \x01x",)], "text string")
    counted = bpe.symbol_table(bpe.bpe_word_counts(df, "text"))
    assert "Aggregate" not in counted._jdf.queryExecution().optimizedPlan().toString()  # no filter can move before the counting
    assert {(r.left, r.right): r.n for r in bpe.bpe_pair_counts(counted).collect()} == {("a", "b"): 3, ("b", "c"): 1}


def test_the_round_trip_query_trains_until_no_pair_is_left(spark, tmp_path, monkeypatch):
    rnd, counts, used = random.Random(7), {}, []
    rows = [(i, " ".join("".join(rnd.choices("abcdeé", k=rnd.randrange(1, 7))) for _ in range(30))) for i in range(4)]
    rows += [(4, None), (4, ""), (None, "\x01\x02  x\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in df.select(F.explode(byte_level_split(F.col("text"))).alias("w")).collect():
        counts[r.w] = counts.get(r.w, 0) + 1

    def report(docs, text, tok):
        used.append(tok)
        return roundtrip_report(docs, text, tok)

    monkeypatch.setattr(catalog_bpe, "roundtrip_report", report)
    assert [tuple(r) for r in QUERIES["roundtrip_bpe"](spark, str(tmp_path)).collect()] == [(7, 0)]
    merges = naive_bpe(counts, 1 << 20)
    tokens = {"<|endoftext|>"} | set("".join(counts)) | {a + b for a, b in merges}
    assert len(merges) > 3 * catalog_bpe.MERGES and {r.token for r in used[0].vocab.collect()} == tokens
