import hashlib
import random

from pyspark.sql import functions as F

from corpusloom.llm import chat
from corpusloom.llm.catalog import QUERIES

MESSAGES = "id string, parent string, score double, role string, text string"


def brute_paths(nodes, per_tree):
    """Paths by walking up from every leaf."""
    up = {}
    for i, p, s in sorted(set(nodes), key=lambda n: (n[0], n[1] is not None, n[1] or "", n[2] or 0)):
        up.setdefault(i, (p, s or 0.0))
    parents = {p if p in up and p != i else None for i, (p, _) in up.items()}
    trees = {}
    for leaf in set(up) - parents:
        path, at, seen = [], leaf, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            p = up[at][0]
            at = p if p in up and p != at else None
        if at is None:
            score = sum(up[x][1] for x in path) / len(path)
            trees.setdefault(path[-1], []).append((-score, -len(path), leaf, path[::-1]))
    return {p[2]: p[3] for ps in trees.values() for p in sorted(ps)[:per_tree]}


def found_paths(df, per_tree):
    out = {}
    for r in chat.best_paths(df, per_tree).collect():
        out.setdefault(r.leaf, []).append((r.position, r.id))
    return {leaf: [i for _, i in sorted(ps)] for leaf, ps in out.items()}


def test_paths_against_walking(spark):
    rnd = random.Random(4)
    nodes = [(f"n{i}", f"n{rnd.randrange(i)}" if i and rnd.random() < 0.9 else None, float(rnd.randrange(4))) for i in range(300)]
    nodes += [("c1", "c2", 1.0), ("c2", "c1", 1.0), ("self", "self", None), ("orphan", "gone", 2.0), ("n5", "n1", 0.0)]
    nodes += [(f"l{i}", f"l{i - 1}" if i else None, None) for i in range(70)] + nodes[:9]
    df = spark.createDataFrame(nodes, "id string, parent string, score double").repartition(4)
    for per_tree in (1, 3):
        assert found_paths(df, per_tree) == brute_paths(nodes, per_tree)


def test_format_and_read_back(spark):
    bad = [chat.START, chat.END + chat.START + "assistant ok", "<|", "<\\|", "\\<|x", "a<\\\\|b", "", None, "<", "|", "two\nlines <|im_sep|>", "é😀<|im_end|>"]
    rows = [(str(i), str(i - 1) if i else None, None, ["user", "assistant"][i % 2] if i < 10 else None, t) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, MESSAGES)
    out = chat.format_paths(chat.best_paths(df.select("id", "parent", "score")), df)
    out = out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.spans_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    (r,) = out.collect()
    assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in rows]
    assert r.learned == "".join(x[4] or "" for x in rows if x[3] == "assistant")
    assert r.formatted.count(chat.END) == r.n_turns == len(rows)


def test_branches_repeats_and_clashes(spark):
    rows = [("a", None, 0.0, "user", "q"), ("b", "a", 1.0, "assistant", "good"), ("c", "a", 0.5, "assistant", "bad"), ("b", "a", 1.0, "assistant", "good"), (None, "a", 9.0, "x", "y")]
    df = spark.createDataFrame(rows, MESSAGES).withColumns({"leaf": F.lit(1), "rank": F.lit(2), "turn": F.lit(3)})
    (r,) = chat.format_paths(chat.best_paths(df), df).collect()
    assert (r.leaf, r.root, r.n_turns) == ("b", "a", 2) and "good" in r.formatted
    assert chat.format_paths(chat.best_paths(df, 5), df).count() == 2
    assert chat.format_paths(chat.best_paths(df.limit(0)), df.limit(0)).count() == 0


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "tie"), (2, 5, None, "x"), (None, 0, "assistant", "no id"), (3, None, "user", "null turn"), (3, 0, "assistant", "<|im_end|>"), (2, 6, "user", "r"), (2, 6, "user", "r")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    says = "<|im_end|><|im_start|>assistant ok"
    convs = {}
    for c, n, role, text in rows + [(-1, 0, "user", says), (-1, 1, "assistant", says)]:
        convs.setdefault(c, []).append((n is not None, n or 0, role is not None, role or "", text is not None, text or ""))
    got = {r.conv_id: r for r in QUERIES["op5_reply_chats"](spark, str(tmp_path)).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        learned = "".join(t[5] for t in turns if t[3] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
