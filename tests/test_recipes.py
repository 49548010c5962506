import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vocab as vocabulary
from corpusloom.operators.tokenize import WordTokenizer
from corpusloom.plans import recipes

TEXTS = [f"word{i % 7} common text number {i}" for i in range(60)] + ["", "  "]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i * 2, t) for i, t in enumerate(TEXTS)], "doc_id long, body string").repartition(3).cache()


@pytest.fixture(scope="module")
def tok(corpus):
    return WordTokenizer(vocabulary.word_vocab(corpus, "body"), model_max_length=16)


def joined(rows, split):
    rows = sorted((r for r in rows if r.split == split), key=lambda r: (r.batch_id, r.block_id))
    return [x for r in rows for x in r.input_ids]


def test_causal(spark, corpus, tok):
    rows = recipes.pretrain_rows(corpus, tok, "doc_id", block_size=100, pct=10, batch_rows=20).collect()
    ids = {r.token: r.id for r in tok.vocab.collect()}
    assert {len(r.input_ids) for r in rows} == {16} and all(r.labels == r.input_ids for r in rows)
    validation = [ids[w] for t in TEXTS[:6] for w in t.split()]
    assert joined(rows, "validation") == validation[: len(validation) // 16 * 16]
    train = []
    for b in (TEXTS[6:26], TEXTS[26:46], TEXTS[46:]):
        batch = [ids[w] for t in b for w in t.split()]
        train += batch[: len(batch) // 16 * 16]
    assert joined(rows, "train") == train


def test_one_batch_for_everything(spark, corpus, tok):
    rows = recipes.pretrain_rows(corpus, tok, "doc_id", pct=0, batch_rows=None, splits=("train",)).collect()
    ids = {r.token: r.id for r in tok.vocab.collect()}
    every = [ids[w] for t in TEXTS for w in t.split()]
    got = [x for r in sorted(rows, key=lambda r: r.block_id) for x in r.input_ids]
    assert got == every[: len(every) // 16 * 16]


def test_masked_lines_and_truncated(spark, corpus, tok):
    masked = recipes.pretrain_rows(corpus, tok, "doc_id", "masked", splits=("train",)).collect()
    assert "labels" not in masked[0] and {len(r.special_tokens_mask) for r in masked} == {16}
    lines = recipes.pretrain_rows(corpus, tok, "doc_id", "lines", pad_to_max=True).collect()
    assert len(lines) == 60 and {len(r.input_ids) for r in lines} == {16}
    cut = recipes.pretrain_rows(corpus, tok, "doc_id", "truncated", caps={"train": 5, "validation": None}).collect()
    assert sum(r.split == "train" for r in cut) == 5 and sum(r.split == "validation" for r in cut) == 3
    assert sorted(r.row_idx for r in cut if r.split == "train") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        recipes.pretrain_rows(corpus, tok, "doc_id", "other")


def test_caps_count_blocks(spark, corpus, tok):
    rows = recipes.pretrain_rows(corpus, tok, "doc_id", batch_rows=20, caps={"train": 4}).where("split = 'train'").collect()
    assert sorted((r.batch_id, r.block_id) for r in rows) == [(0, 0), (0, 1), (0, 2), (0, 3)]


def test_given_splits_are_kept(spark, corpus, tok):
    tagged = corpus.withColumn("split", F.when(F.col("doc_id") < 20, "validation").otherwise("train"))
    assert {s: d.count() for s, d in recipes.split_parts(tagged, 50, "doc_id").items()} == {"train": 52, "validation": 10}
    train_only = corpus.withColumn("split", F.when(F.col("doc_id") < 20, "test").otherwise("train"))
    got = {s: d.count() for s, d in recipes.split_parts(train_only, 50, "doc_id").items()}
    assert got == {"test": 10, "train": 26, "validation": 26}
    with pytest.raises(ValueError, match="missing"):
        recipes.pretrain_rows(tagged, tok, "doc_id", splits=("test",), block_size=4)


def test_splits_are_pushed_to_the_scan(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "c"))
    parts = recipes.split_parts(spark.read.parquet(str(tmp_path / "c")), 10, "doc_id")
    for name, pushed in (("train", "GreaterThan(doc_id,10)"), ("validation", "LessThanOrEqual(doc_id,10)")):
        assert pushed in parts[name]._jdf.queryExecution().executedPlan().toString()


def test_instructions(spark, tok):
    data = [(i, "train" if i else "test", f"word{i}", "" if i == 1 else "text", [["common", "text"]]) for i in range(5)]
    df = spark.createDataFrame(data, "row_idx long, split string, prompt string, response string, history array<array<string>>")
    llama = recipes.instruction_rows(df, tok, "llama", 8, 4, "ziya_prompt", keep_source=("row_idx",)).collect()
    assert len(llama) == 5 and {len(r.input_ids) for r in llama} == {12}
    bos = recipes.instruction_rows(df, tok, "bos", 8, 4, caps={"train": 2}, keep_source=("row_idx",)).collect()
    assert sorted(r.row_idx for r in bos) == [0, 2]
    for style in ("halves", "prefix"):
        assert recipes.instruction_rows(df, tok, style, 8, 6).columns == ["split", "input_ids", "labels"]
    with pytest.raises(KeyError):
        recipes.instruction_rows(df, tok, "other")


def test_predict_file(spark, tmp_path):
    def answer(adapter, path):
        return lambda prompts: [f"{p} answer from {path}\nEND</s>" for p in prompts]

    rows = [{"input": f"ask {i}", "adapter_name": "a", "id": i, "note": None} for i in range(20)]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "input string, adapter_name string, id long, note string"
    recipes.predict_file(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), answer, schema, adapters="a,/m/a")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{**r, "target": "answer from /m/a"} for r in rows]
    plain = recipes.predict_rows(spark.read.schema(schema).json(str(tmp_path / "in.json")), answer, None, eos=None)
    assert plain.first().target == "answer from None</s>"
