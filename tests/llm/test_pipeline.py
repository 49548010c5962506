import pytest

import corpus_pipeline
from corpusloom.llm import language_id
from corpusloom.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Input of the first stage and result of each stage."""
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        out.append(docs)
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_order(tables):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    assert all(t.columns == tables[0].columns for t in tables[1:5])
    assert "ids" in tables[5].columns


def test_each_stage_takes_effect(spark, tables, sf_dir):
    start, quality, language, near, mixed, pieces = tables
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, sf_dir).where("kept").collect()}
    assert set(ids(quality)) == kept
    model = language_id.fit(quality, ~__import__("corpusloom.llm.catalog", fromlist=["x"]).held_out())
    told = {r.doc_id: model.predict(r.text) for r in quality.collect()}
    assert {r.doc_id: r.lang for r in language.collect()} == {k: t[0] for k, t in told.items() if t[0] != "und" and not t[2]}
    from test_ngram_join import brute

    classes = {c for _, c, _, _ in brute([(r.doc_id, r.text) for r in language.collect()])}
    assert sorted(ids(near)) == sorted(classes)
    times = {}
    for k in ids(mixed):
        times[k] = times.get(k, 0) + 1
    assert set(times) <= classes and max(times.values()) <= 3
    assert sorted(ids(pieces)) == sorted(ids(mixed))


def test_run_gives_the_same(spark, tables, sf_dir):
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in tables[5].collect())


def test_every_operator_has_a_query():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)
