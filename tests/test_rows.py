"""Conversations, prediction, streams and whole plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.sequences import Specials
from corpusloom.operators import instruct, order, predict, vocab as vocabulary
from corpusloom.operators.conversation import turn_pairs, turns_to_instructions, with_history
from corpusloom.operators.pack import pack
from corpusloom.operators.templates import apply_template
from corpusloom.operators.tokenize import WordTokenizer, encode
from corpusloom.plans.catalog import streamed
from corpusloom.streaming import pack_stream, read_stream, run_available
from corpusloom.streaming.pack import _places, shard

SP = Specials()


def conversation_model(turns):
    out = {}
    for conv in sorted({t[0] for t in turns}):
        spoken = [t for t in sorted(turns) if t[0] == conv and t[2] in ("user", "assistant")]
        history = []
        for before, now in zip(spoken, spoken[1:]):
            if before[2] == "user" and now[2] == "assistant":
                out[conv, now[1]] = (before[3], now[3], list(history))
                history.append([before[3], now[3]])
    return out


def random_turns(seed, hot):
    rnd = random.Random(seed)
    turns = []
    for conv in range(6):
        for turn in range(hot if conv == 2 else rnd.randrange(0, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system"])
            turns.append((conv, turn * 2, role, f"{conv}.{turn}"))
    rnd.shuffle(turns)
    return turns


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_one_long_conversation_among_short_ones(spark, chunk):
    turns = random_turns(chunk, 60)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    out = with_history(turn_pairs(df), chunk)
    got = {(r.conv_id, r.turn): (r.prompt, r.response, r.history) for r in out.collect()}
    assert got == conversation_model(turns)


def test_open_questions(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "assistant", "f")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.prompt, r.response) for r in turn_pairs(df, keep_open=True).collect())
    assert got == [(0, "a", None), (1, "b", "c"), (4, "e", None)]
    assert [(r.turn, r.prompt) for r in turns_to_instructions(df, history=False).collect()] == [(2, "b")]


# --- prediction -----------------------------------------------------------------------------------


def test_adapter_list():
    assert predict.parse_adapters(" a , /1,, b,/2 ,a,/3") == {"a": "/3", "b": "/2"}
    with pytest.raises(ValueError):
        predict.parse_adapters("a,/1,b")


def test_route(spark):
    df = spark.createDataFrame([("x", "a"), ("y", "b")], "input string, adapter_name string")
    got = {r.input: r.adapter_path for r in predict.route(df, "a,/1,b,/2").collect()}
    assert got == {"x": "/1", "y": "/2"}
    with pytest.raises(Exception, match="unknown adapter: b"):
        predict.route(df, "a,/1").collect()
    null = spark.createDataFrame([("x", None)], "input string, adapter_name string")
    with pytest.raises(Exception, match="unknown adapter: null"):
        predict.route(null, "a,/1").collect()
    with pytest.raises(ValueError, match="no column"):
        predict.route(df.drop("adapter_name"), "a,/1")


def test_predict_keeps_every_row_and_spreads_a_popular_adapter(spark):
    rows = [(f"t{i}", "a" if i % 10 else "b", {"k": i}) for i in range(400)]
    df = predict.route(spark.createDataFrame(rows, "input string, adapter_name string, extra map<string,int>"), "a,/1,b,/2")

    def factory(adapter, path):
        return lambda prompts: [f"{p}@{path}" for p in prompts]

    out = predict.predict(df, factory, adapter="adapter_name", partitions=8)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.out_text for r in got) == sorted(f"{t}@{'/1' if a == 'a' else '/2'}" for t, a, _ in rows)
    assert len({r.task for r in got if r.adapter_name == "a"}) > 2
    assert {r.extra["k"] for r in got} == set(range(400))
    plain = predict.predict(df, factory, F.upper("input")).where("input = 't3'").first()
    assert (plain.prompt_text, plain.out_text) == ("T3", "T3@None")


#: Generated text after the prompt "p" -> answer with the end mark </s>, without an end mark, with only a leading prompt cut.
ANSWERS = {
    "p a": ("a", "a", "a"),
    "p a p b": ("a  b", "a  b", "a p b"),
    "p a\nEND": ("a", "a", "a"),
    "p a </s>": ("a ", "a </s>", "a </s>"),
    "p a</s>  ": ("a", "a</s>", "a</s>"),
    "p a </s></s>": ("a </s>", "a </s></s>", "a </s></s>"),
    "p": ("", "", ""),
    "p  \u3000": ("", "", ""),
    "x\n\nEND y\nEND": ("x\n y", "x\n y", "x\n y"),
    "p(.*) $1 \\ p a": ("(.*) $1 \\  a", "(.*) $1 \\  a", "(.*) $1 \\ p a"),
}


@pytest.mark.parametrize("out", ANSWERS)
def test_clean_answer(spark, out):
    df = spark.createDataFrame([(out, "p")], "o string, p string")
    row = df.select(
        predict.clean_answer("o", "p", "</s>"),
        predict.clean_answer("o", "p", None),
        predict.clean_answer("o", "p", None, prefix_only=True),
    ).first()
    assert tuple(row) == ANSWERS[out]


def test_prediction_passes_every_value_through(spark):
    rows = [(2**60 + 1, "a", 1.5, [1, None]), (None, "b", None, None), (2**53 + 1, None, 0.0, [])] * 3
    df = spark.createDataFrame(rows, "id long, input string, x double, l array<int>").repartition(2)
    out = predict.predict(df, lambda who, path: lambda prompts: [f"{p}!" for p in prompts])
    assert sorted(((r.id, r.input, r.x, r.l, r.out_text) for r in out.collect()), key=repr) == sorted(((*r, f"{r[1]}!") for r in rows), key=repr)


def word_tokenizer(spark, texts):
    return WordTokenizer(vocabulary.word_vocab(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))


def test_prepare_a_test_split(spark):
    rows = [(i, "test" if i > 2 else "train", f"w{i}", "" if i == 3 else "ok") for i in range(9)]
    df = spark.createDataFrame(rows, "row_idx long, split string, prompt string, response string")
    tok = word_tokenizer(spark, ["ok"] + [r[2] for r in rows])
    options = dict(max_source=8, max_target=8, tokenizer=tok, history=None, keep_source=("row_idx",))
    assert sorted(r.row_idx for r in predict.prepare(df, "test", **options).collect()) == [4, 5, 6, 7, 8]
    # The cap counts rows before empty ones are dropped.
    assert sorted(r.row_idx for r in predict.prepare(df, "test", 3, **options).collect()) == [4, 5]
    with pytest.raises(ValueError, match="missing"):
        predict.prepare(df, "validation", **options)


# --- streams --------------------------------------------------------------------------------------


def write_files(folder, files):
    folder.mkdir()
    for i, rows in enumerate(files):
        (folder / f"f{i}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(folder)


SCHEMA = "row_idx long, prompt string, response string, history array<array<string>>"


def test_stream_equals_batch(spark, tmp_path):
    files = [[{"row_idx": f * 10 + i, "prompt": f"ask {i}", "response": f"tell {f}", "history": []} for i in range(5)] for f in range(3)]
    path = write_files(tmp_path / "in", files)
    tok = word_tokenizer(spark, ["ask tell 0 1 2 3"])

    def build(df):
        llama = instruct.sft_llama(apply_template(df, "ziya_prompt", keep_source=("row_idx",)), 16, 8, tok, keep_source=("row_idx",))
        bos = instruct.sft_bos(df, 16, 8, tok, keep_source=("row_idx",))
        return llama.unionByName(bos)

    stream = read_stream(spark, path, "json", SCHEMA, max_files=1)
    got = run_available(build(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    want = build(spark.read.schema(SCHEMA).json(path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_reader_arguments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert read_stream(spark, str(tmp_path), "text").columns == ["text"]
    with pytest.raises(ValueError, match="schema"):
        read_stream(spark, str(tmp_path), "json")
    with pytest.raises(ValueError, match="unknown format"):
        read_stream(spark, str(tmp_path), "xml")


def token_files(tmp_path, n_files, rows):
    return write_files(
        tmp_path / "tok",
        [[{"row_idx": f * rows + i, "input_ids": [f * rows + i] * (i % 4)} for i in range(rows)] for f in range(n_files)],
    )


def test_stream_pack_drops_one_rest_per_batch(spark, tmp_path):
    path = token_files(tmp_path, 3, 20)
    stream = read_stream(spark, path, "json", "row_idx long, input_ids array<int>", max_files=1)
    pack_stream(stream, 7, "row_idx", str(tmp_path / "out"), str(tmp_path / "state"), batch_rows=10).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = pack(spark.read.schema("row_idx long, input_ids array<int>").json(path), 7, 10)
    assert sorted(r.input_ids for r in got.collect()) == sorted(r.input_ids for r in want.collect())
    # The same files again: nothing new, nothing written twice.
    pack_stream(stream, 7, "row_idx", str(tmp_path / "out"), str(tmp_path / "state"), batch_rows=10).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()
    with pytest.raises(ValueError, match="streaming frame"):
        pack_stream(got, 7)


def test_stream_pack_with_carry_loses_nothing(spark, tmp_path):
    path = token_files(tmp_path, 3, 20)
    stream = read_stream(spark, path, "json", "row_idx long, input_ids array<int>", max_files=1)
    stream = stream.select("*", shard("row_idx", 2))
    out = run_available(pack_stream(stream, 7, carry=True), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = out.collect()
    source = spark.read.schema("row_idx long, input_ids array<int>").json(path).select("*", shard("row_idx", 2))
    for s in (0, 1):
        joined = [t for r in source.where(F.col("shard") == s).orderBy("row_idx").collect() for t in r.input_ids]
        blocks = [r.input_ids for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.block_id)]
        assert [t for b in blocks for t in b] == joined[: len(joined) // 7 * 7]


def test_carry_keeps_the_order_over_arrow_batches(spark, tmp_path):
    rows = [{"row_idx": i, "input_ids": [i]} for i in range(400)]
    random.Random(1).shuffle(rows)
    path = write_files(tmp_path / "in", [rows])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        stream = read_stream(spark, path, "json", "row_idx long, input_ids array<int>").withColumn("shard", F.lit(0))
        out = run_available(pack_stream(stream, 7, carry=True), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blocks = [r.input_ids for r in sorted(out, key=lambda r: r.block_id)]
    assert [t for b in blocks for t in b] == list(range(399))


def test_carry_spreads_one_value_over_many_tasks(spark, tmp_path):
    """One value with nearly all rows, a null value, empty rows; over three micro-batches and a restart."""
    rnd = random.Random(5)
    rows = [{"k": i, "source": rnd.choice(["hot"] * 9 + ["cold", None]), "ids": [rnd.randrange(99)] * rnd.choice([0, 1, 5, 40])} for i in range(600)]
    schema = "k long, source string, ids array<int>"
    path = write_files(tmp_path / "in", [rows[:200], rows[200:400]])
    for arrives in ([], rows[400:]):  # the third file comes after a stop
        if arrives:
            (tmp_path / "in" / "late.json").write_text("\n".join(json.dumps(r) for r in arrives) + "\n")
        stream = read_stream(spark, path, "json", schema, max_files=1)
        packed = pack_stream(stream, 7, carry=True, by="source", column="ids", order="k")
        out = run_available(packed, str(tmp_path / "out"), str(tmp_path / "state"))
        assert out.columns == ["source", "block_id", "ids", "labels"]
    got = out.collect()
    for source in ("hot", "cold", None):
        joined = [t for r in rows if r["source"] == source for t in r["ids"]]
        blocks = sorted((r for r in got if r.source == source), key=lambda r: r.block_id)
        assert [r.block_id for r in blocks] == list(range(len(joined) // 7))
        assert [t for r in blocks for t in r.ids] == joined[: len(joined) // 7 * 7] and all(r.ids == r.labels for r in blocks)
    hot = [{"by": "hot", "turn": 1, "order": i, "ids": [i], "made": 0, "n": 1, "tie": i} for i in range(400)]
    placed, _ = _places(spark.createDataFrame(hot, "by string, turn int, order long, ids array<int>, made long, n long, tie long"), 7, ["ids"])
    assert [r.start for r in placed.orderBy("row").collect()] == list(range(400))
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in" / "rows.parquet"))
    stream = streamed(spark, str(tmp_path / "in"), "rows")
    out = run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in out.collect()) == list(range(30))


def test_encode_takes_streams(spark, tmp_path):
    path = write_files(tmp_path / "in", [[{"row_idx": 1, "prompt": "a b", "response": "c", "history": []}]])
    tok = word_tokenizer(spark, ["a b"])
    stream = encode(read_stream(spark, path, "json", SCHEMA), "prompt", tok, special=True, keep_source=("row_idx",))
    (row,) = run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert row.input_ids == [1, 5, 6, 2]
