"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double the reach of a pointer give
every message its root, its depth and the score of its branch in log2(depth) rounds; the leaves of
a tree are ranked by that score, and the same pointers then list the messages of each chosen path,
again in log2(depth) joins. A path becomes one conversation in one row. Texts travel only in the
last join. Only DataFrame functions are used.

Layout of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts every ``<``,
backslashes, ``|`` gets one more backslash, so no control string can occur in them, and taking one
away gives the text back. The loss mask covers the texts of assistant turns.

Defined cases: null or empty roles and texts are empty strings; a message without a parent, with
itself as parent or with an unknown one is a root; messages on a cycle reach no root and belong to
no path; a repeated row is the same message and counts once; of several rows with one id the least
(parent, score) gives its place and the least (role, text) its content; null ids are left out. An
empty table gives no conversations. A conversation is one row, so Spark's row limit of 2 GB holds
for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut_lineage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SALTS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(root, leaf, rank, position, id) of the chosen paths of a table (id, parent, score).

    The score of a path is the mean score of its messages, 0 where null; ties go to the longer
    path, then to the lesser leaf id.
    """
    place = nodes.where(F.col("id").isNotNull()).groupBy("id")
    tree = place.agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("p"))
    tree = cut_lineage(tree.select("id", "p.parent", "p.score"), "chat-nodes")
    known = tree.select(F.col("id").alias("parent")).withColumn("__known", F.lit(True))
    start = tree.join(known, "parent", "left").select(
        "id",
        F.when(F.col("__known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("up"),
        F.lit(1).alias("turns"),
        F.col("score").alias("gain"),
        F.col("id").alias("top"),
    )
    # reach[k]: the ancestor 2^k above each message that has one.
    state, reach = cut_lineage(start, "chat-up"), []
    limit = max(1, tree.count()).bit_length()
    while len(reach) <= limit:
        jumps = state.where(F.col("up").isNotNull()).select("id", "up")
        if jumps.isEmpty():
            break
        reach.append(jumps)
        above = state.select(*[F.col(c).alias(f"a_{c}") for c in state.columns])
        # Only messages that have not reached their root take part; each finds one row.
        moved = state.where(F.col("up").isNotNull()).join(above, F.col("up") == F.col("a_id")).select(
            "id",
            F.col("a_up").alias("up"),
            (F.col("turns") + F.col("a_turns")).alias("turns"),
            (F.col("gain") + F.col("a_gain")).alias("gain"),
            F.col("a_top").alias("top"),
        )
        state = cut_lineage(state.where(F.col("up").isNull()).unionByName(moved), "chat-up")
    answered = start.where(F.col("up").isNotNull()).select(F.col("up").alias("id"))
    leaves = state.where(F.col("up").isNull()).join(answered, "id", "left_anti")
    leaves = leaves.select(F.col("top").alias("root"), F.col("id").alias("leaf"), "turns", (F.col("gain") / F.col("turns")).alias("score"))
    # Two turns of ranking, so that a tree with very many leaves is spread over many tasks.
    order = [F.desc("score"), F.desc("turns"), F.asc("leaf")]
    salted = leaves.withColumn("__salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    first = Window.partitionBy("root", "__salt").orderBy(*order)
    best = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_tree).drop("rank", "__salt")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    best = cut_lineage(best.where(F.col("rank") <= per_tree), "chat-leaves")
    # Each ancestor is met once: by the binary digits of its distance from the leaf.
    path = best.select("root", "leaf", "rank", "score", "turns", F.col("leaf").alias("id"), F.lit(0).alias("back"))
    for k in reversed(range(len(reach))):
        more = path.join(reach[k], "id").select("root", "leaf", "rank", "score", "turns", F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        path = path.unionByName(more)
        if k:
            path = cut_lineage(path, "chat-path")
    return path.select("root", "leaf", "rank", "score", (F.col("turns") - F.col("back")).alias("position"), "id")


def format_paths(paths: DataFrame, messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: leaf, root, rank, score, n_turns, formatted, loss_spans.

    ``loss_spans`` holds (start, length) in code points of the text to learn from, from 0.
    """
    said = messages.where(F.col("id").isNotNull()).groupBy("id")
    said = said.agg(F.min(F.struct(escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))).alias("m"))
    turns = paths.join(said, "id").withColumn(
        "turn", F.concat(F.lit(START), "m.role", F.lit(SEP), "m.text", F.lit(END))
    )
    by = ["leaf", "root", "rank", "score"]
    upto = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("m.text")
    turns = turns.withColumn("start", F.sum(F.length("turn")).over(upto) - len(END) - size)
    span = F.when(F.col("m.role") == escape(F.lit(learn)), F.struct("start", size.cast("bigint").alias("length")))
    rows = turns.select(*by, F.struct("position", "turn", span.alias("span")).alias("t"))
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return whole.select(
        *by,
        F.size("ts").cast("bigint").alias("n_turns"),
        F.array_join(F.col("ts.turn"), "").alias("formatted"),
        F.filter(F.col("ts.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    parts = F.split(formatted, r"<\|im_end\|>")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), SEP, 1)).alias("role"),
            unescape(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def spans_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def reply_chain(turns: DataFrame) -> DataFrame:
    """Messages (id, parent, score, conv_id, role, text) of a table of numbered turns: each answers
    the one before it. Turns that share a number are ordered by role and text; equal ones stay."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    numbered = turns.select("conv_id", "role", "text", n.alias("n"), conv.alias("conv"))
    return numbered.select(
        F.concat_ws(":", "conv", "n").alias("id"),
        F.when(F.col("n") > 1, F.concat_ws(":", "conv", F.col("n") - 1)).alias("parent"),
        F.lit(None).cast("double").alias("score"),
        "conv_id",
        "role",
        "text",
    )
