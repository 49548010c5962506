import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.sequences import Specials, proportional_budget
from corpusloom.operators import instruct

SP = Specials()


class Letters:
    """Tokenizer for tests: a text is a list of numbers."""

    specials = SP
    model_max_length = 1000

    def with_ids(self, df, texts, key=None):
        to_ids = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast("int"))
        return df.withColumns({o: to_ids(F.col(t) if isinstance(t, str) else t) for o, t in texts.items()})


TOK = Letters()


def run(spark, build, pairs, *args, **options):
    rows = [(i, " ".join(map(str, a)) or " ", " ".join(map(str, b)) or " ") for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, source string, target string")
    df = df.withColumns({"prompt": F.col("source"), "response": F.col("target")})
    out = build(df, *args, TOK, keep_source=("i",), **options).orderBy("i").collect()
    return [(r.input_ids, r.labels) for r in out]


def sizes(rnd, n, limit):
    return [[rnd.randrange(5, 99) for _ in range(rnd.randrange(0, limit))] for _ in range(n)]


def fill(row, n, value):
    return row + [value] * (n - len(row))


def llama(a, b, S, T):
    if len(a) + len(b) > S + T - 2:
        a, b = a[: S - 1], b[: T - 1]
    head, tail = [SP.bos] + a, b + [SP.eos]
    return fill(head + tail, S + T, SP.pad), fill([-100] * len(head) + tail, S + T, -100)


def halves(a, b, S, T):
    x = fill([SP.bos] + a[: S - 3] + [SP.eos], S - 1, SP.pad)
    y = fill([SP.bos] + b[: T - 3] + [SP.eos], T - 1, SP.pad)
    return x + y, [-100] * len(x) + y


def hide(labels):
    return [-100 if v == SP.pad else v for v in labels]


def bos(a, b, S, T, total):
    a, b = a[: max(S - 1, 0)], b[: max(T - 2, 0)]
    x = a + [SP.mask, SP.bos] + b + [SP.eos]
    at = x.index(SP.bos)
    return fill(x, total, SP.pad), hide(fill([-100] * at + x[at:], total, SP.pad))


def prefix(a, b, S, T, total, strict=False):
    x = a[: max(S - 2, 0)] + [SP.mask, SP.bos]
    y = b[: max(T - (1 if strict else 0), 0)] + [SP.eos]
    return fill(x + y, total, SP.pad), hide(fill([SP.pad] * len(x) + y, total, SP.pad))


#: Lengths of two sides -> their shares of ten, worked out by hand.
SHARES = {
    (5, 5): (5, 5),
    (7, 7): (5, 5),
    (1, 9): (1, 9),
    (9, 1): (9, 1),
    (3, 1): (7, 3),
    (2, 1): (6, 4),
    (4, 12): (2, 8),
    (20, 1): (9, 1),
    (1, 20): (1, 9),
    (0, 6): (0, 10),
    (6, 0): (10, 0),
    (0, 0): (0, 10),
}


def shared_pairs():
    return [([7 + i for i in range(s)], [50 + i for i in range(t)]) for s, t in SHARES]


def test_shares_of_a_budget(spark):
    df = spark.createDataFrame(list(SHARES), "s int, t int")
    both = F.struct(*proportional_budget(F.col("s"), F.col("t"), 10))
    assert {(r.s, r.t): tuple(r.b) for r in df.select("s", "t", both.alias("b")).collect()} == SHARES


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(3)
    S, T = 8, 6
    exact = [(S + T - 2 - t, t) for t in range(0, S + T - 1)] + [(S + T - 1 - t, t) for t in range(0, S + T)]
    exact += [(S - 1, T - 2), (S, T - 1), (S, T), (0, 0), (0, 20), (20, 0), (20, 1)]
    fixed = [([7] * s, [9] * t) for s, t in exact]
    return fixed + list(zip(sizes(rnd, 40, 20), sizes(rnd, 40, 20)))


def test_llama(spark, pairs):
    assert run(spark, instruct.sft_llama, pairs, 8, 6) == [llama(a, b, 8, 6) for a, b in pairs]


def test_halves(spark, pairs):
    assert run(spark, instruct.sft_halves, pairs, 8, 6) == [halves(a, b, 8, 6) for a, b in pairs]


def test_bos(spark, pairs):
    assert run(spark, instruct.sft_bos, pairs, 8, 6, history=None) == [bos(a, b, 8, 6, 14) for a, b in pairs]


def test_bos_with_shared_budget(spark):
    want = [bos(a, b, *SHARES[len(a), len(b)], 10) for a, b in shared_pairs()]
    assert run(spark, instruct.sft_bos, shared_pairs(), 8, 6, history=None, max_length=10) == want


@pytest.mark.parametrize("strict", [False, True])
def test_prefix(spark, pairs, strict):
    want = [prefix(a, b, 8, 6, 14, strict) for a, b in pairs]
    assert run(spark, instruct.sft_prefix, pairs, 8, 6, history=None, strict=strict) == want
    assert max(len(w[0]) for w in want) == (14 if strict else 15)


def test_prefix_with_shared_budget(spark):
    want = [prefix(a, b, *SHARES[len(a), len(b)], 10) for a, b in shared_pairs()]
    assert run(spark, instruct.sft_prefix, shared_pairs(), 8, 6, history=None, max_length=10) == want


def test_pad_id_in_target_is_hidden_unless_asked(spark):
    (_, hidden), = run(spark, instruct.sft_bos, [([7], [0, 9])], 8, 6, history=None)
    (_, shown), = run(spark, instruct.sft_bos, [([7], [0, 9])], 8, 6, history=None, ignore_pad=False)
    assert hidden[:6] == [-100, -100, 1, -100, 9, 2] and shown[:6] == [-100, -100, 1, 0, 9, 2]


def test_rows_without_text_are_left_out(spark):
    df = spark.createDataFrame([("7", "8"), ("", "8"), ("7", None), (None, "8"), ("7", "")], "prompt string, response string")
    assert instruct.sft_bos(df, 8, 6, TOK, history=None).count() == 1


@pytest.mark.parametrize("m", [1, 2, 10])
def test_budget_is_used_up_and_falls_to_the_longer_side(spark, m):
    pairs = [(s, t) for s in range(0, 14) for t in range(0, 14)]
    a, b = proportional_budget(F.col("s"), F.col("t"), m)
    for r in spark.createDataFrame(pairs, "s int, t int").select("s", "t", a.alias("a"), b.alias("b")).collect():
        assert r.a + r.b == m
        if 0 < r.s < r.t and r.a > r.s:
            assert r.b >= r.a



def test_seq2seq_pads_inside_its_batch(spark):
    rows = [(0, "5 6 7", "8"), (1, "5", "8 9"), (2, "5", ""), (3, "5 6", "8"), (4, "5", "0")]
    df = spark.createDataFrame(rows, "row_idx long, prompt string, response string")
    out = instruct.seq2seq_rows(df, 8, 6, TOK, history=None, batch_rows=3).orderBy("row_idx").collect()
    assert [r.row_idx for r in out] == [0, 1, 3, 4]
    assert [r.input_ids for r in out] == [[5, 6, 7, 4, 1], [5, 4, 1, 0, 0], [5, 6, 4, 1], [5, 4, 1, 0]]
    assert [r.attention_mask for r in out] == [[1] * 5, [1, 1, 1, 0, 0], [1] * 4, [1, 1, 1, 0]]
    assert [r.labels for r in out] == [[8, 4, 1], [8, 9, 4, 1], [8, 4, 1], [-100, 4, 1]]


def test_check_sequences(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([1], [1, 2]), ([1, 2, 3], [1, 2, 3])], "input_ids array<int>, labels array<int>")
    r = instruct.check_sequences(df, 2).first()
    assert (r.rows, r.unequal, r.wrong_length) == (3, 1, 2)
    assert instruct.check_sequences(df, 2, exact=False).first().wrong_length == 1
    with pytest.raises(ValueError):
        instruct.check_sequences(df, 2, fail=True)
