"""Long conversation tables to instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.order import with_row_index
from corpusloom.operators.templates import ROUND_FORMAT, render_turn
from corpusloom.operators.tokenize import Tokenizer
from corpusloom.session import cut_lineage

CHUNK = 1_024


def turn_pairs(df: DataFrame, keep_open: bool = False) -> DataFrame:
    """``(conv_id, turn, role, text)`` to ``(conv_id, turn, pos, prompt, response)``.

    A user turn directly followed by an assistant turn is a pair; other roles are left out first.
    ``turn`` is that of the answer. ``keep_open`` also returns user turns without an answer
    (response null); ``turn`` is then that of the question.

    All turns are sorted by range of ``(conv_id, turn)``, not grouped by conversation, so one huge
    conversation is spread over many ranges. Every range begins with a user turn: a question and
    its answer are never apart, and the neighbour inside the range is enough.
    """
    spoken = df.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    user = F.col("role") == "user"
    step = F.lead if keep_open else F.lag
    beside = {f"__{c}": step(c) for c in ("conv_id", "role", "text")}
    rows = with_row_index(spoken, ["conv_id", "turn"], "pos", cut_at=user, extra=beside)
    same = F.col("__conv_id").eqNullSafe(F.col("conv_id"))
    if keep_open:
        answer = F.when(same & (F.col("__role") == "assistant"), F.col("__text"))
        return rows.where(user).select("conv_id", "turn", "pos", F.col("text").alias("prompt"), answer.alias("response"))
    asked = ~user & same & (F.col("__role") == "user")
    return rows.where(asked).select("conv_id", "turn", "pos", F.col("__text").alias("prompt"), F.col("text").alias("response"))


def _conversation() -> Column:
    """A key that joins; null is a conversation too."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def with_history(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``history``: all earlier pairs of the conversation as ``[[q, a], ...]``.

    A conversation is handled in chunks of positions. Inside a chunk a running list is enough;
    conversations that cross a chunk border hand their earlier pairs on to their later chunks.
    """
    pairs = pairs.withColumns({"chunk": F.floor(F.col("pos") / chunk), "__conv": _conversation()})
    qa = F.array("prompt", "response")
    running = Window.partitionBy("__conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = pairs.withColumn("near", F.collect_list(qa).over(running))
    spans = (
        pairs.groupBy("__conv")
        .agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
    )
    handed = (
        pairs.join(spans, "__conv")
        .where(F.col("chunk") < F.col("hi"))
        .groupBy("__conv", "chunk", "hi")
        .agg(F.array_sort(F.collect_list(F.struct("pos", qa.alias("qa")))).alias("part"))
        .withColumn("to", F.explode(F.sequence(F.col("chunk") + 1, F.col("hi"))))
        .groupBy("__conv", F.col("to").alias("chunk"))
        .agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("parts"))
        .select("__conv", "chunk", F.transform("parts", lambda p: p["qa"]).alias("far"))
    )
    none = F.array().cast("array<array<string>>")
    return (
        inside.join(handed, ["__conv", "chunk"], "left")
        .withColumn("history", F.concat(F.coalesce("far", none), "near"))
        .drop("__conv", "chunk", "near", "far")
    )


def with_head_history(pairs: DataFrame, limit: int, tokenizer: Tokenizer, chunk: int = CHUNK, **form) -> DataFrame:
    """Add ``history`` as far as the first ``limit`` tokens of the rendered source can show it.

    Sources are cut from behind, so of the earlier pairs only those that begin before the limit
    matter, and they are the same for all turns of a conversation: its head. Each pair that can be
    in a head is tokenized once; a pair has a token at least, so a head has ``limit`` pairs with
    text at most. Rows are handled in chunks of positions as in ``with_history``, but what a chunk
    gets from the earlier ones is the head, so the work grows with the turns and not with their
    square. A turn must end in white space, where no token goes on; with ``max_length``, whose
    budgets follow the whole lengths, ``with_history`` is the one to use.
    """
    turn_end = form.get("turn_format", ROUND_FORMAT).split("{a}")[1] + form.get("separator", "\n")
    if not turn_end[-1:].isspace():
        raise ValueError("a turn must end in white space for its tokens to be counted alone")
    spoken = (F.col("prompt").isNotNull() & F.col("response").isNotNull()).cast("int")
    rows = pairs.withColumns({"__conv": _conversation(), "__chunk": F.floor(F.col("pos") / chunk), "__spoken": spoken})
    inside = Window.partitionBy("__conv", "__chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__n": F.count("pos").over(inside), "__told": F.coalesce(F.sum("__spoken").over(inside), F.lit(0))})
    chunks = rows.groupBy("__conv", "__chunk").agg(F.count("*").alias("n"), F.sum("__spoken").alias("told"))
    earlier = Window.partitionBy("__conv").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    chunks = chunks.select(
        "__conv", "__chunk", F.coalesce(F.sum("n").over(earlier), none).alias("__n0"), F.coalesce(F.sum("told").over(earlier), none).alias("__told0")
    )
    chunks = cut_lineage(chunks, "chunks")
    rows = rows.join(chunks, ["__conv", "__chunk"]).withColumn("__n", F.col("__n") + F.col("__n0"))
    first = rows.where(F.col("__told") + F.col("__told0") < limit)
    text = F.coalesce(render_turn(F.col("__n"), F.col("prompt"), F.col("response"), **form), F.lit(""))
    counted = tokenizer.with_ids(first.select("__conv", "pos", "__n", "prompt", "response", text.alias("__text")), {"__ids": "__text"}, "pos")
    upto = F.coalesce(F.sum(F.size("__ids")).over(Window.partitionBy("__conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = counted.select("__conv", "__n", F.array("prompt", "response").alias("qa"), upto.alias("upto")).where(F.col("upto") < limit)
    head = head.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__n", "qa"))).alias("head"))
    heads = chunks.select("__conv", "__chunk").join(head.select("__conv", F.transform("head", lambda h: h["qa"]).alias("__head")), "__conv")
    history = F.slice("__head", F.lit(1), F.least(F.col("__n"), F.size("__head")).cast("int"))
    return rows.join(heads, ["__conv", "__chunk"]).select(*pairs.columns, history.alias("history"))


def turns_to_instructions(
    df: DataFrame, history: bool = True, limit: int | None = None, tokenizer: Tokenizer | None = None, **form
) -> DataFrame:
    """Rows ``(conv_id, turn, pos, prompt, response[, history])``, one per answered user turn.

    With ``limit`` and a tokenizer a history ends where a source of that many tokens is full.
    """
    pairs = turn_pairs(df)
    # Histories read the pairs several times.
    if history and limit is not None:
        if tokenizer is None:
            raise ValueError("a limit in tokens needs the tokenizer")
        return with_head_history(cut_lineage(pairs, "pairs"), limit, tokenizer, **form)
    return with_history(cut_lineage(pairs, "pairs")) if history else pairs
