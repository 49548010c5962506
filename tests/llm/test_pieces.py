import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pieces
from corpusloom.llm.catalog import QUERIES, piece_model

sentencepiece = pytest.importorskip("sentencepiece")
pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")

ODD = [
    "", " ", "   ", "  Hello  world \n\tfoo 中\U0001f600 ▁▁ x▁y ", "\0a\0", "a" * 5_000, "<s> </s><unk>", " ▁ ▁", "é̈‍�",
    "word " * 30_000, "Ｆｕｌｌ ﬁne ①", "the same", "the same",
]


@pytest.fixture(scope="module")
def proto():
    with open(piece_model(), "rb") as file:
        return file.read()


def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice(" ▁abcé中😀\n\tñ.") for _ in range(rnd.randrange(60))) for _ in range(400)]


def test_ids_and_decoding_equal_the_library(spark, proto):
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    rows = [(i, t, "x") for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = pieces.encode_pieces(df, piece_model()).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert list(r.ids) == want and r.decoded == library.decode(want)
        assert len(r.starts) == len(r.ends) == len(want)


def test_spans_cover_the_text(proto):
    codec = pieces.PieceCodec(proto)
    for text, (ids, starts, ends) in zip(texts(), codec.encode(texts())):
        raw = text.encode()
        assert (starts <= ends).all() and ends[-1] == len(raw)
        joined = b"".join(raw[a:b] for a, b in zip(starts, ends))
        assert joined == raw


@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_map_like_the_library(proto, squeeze, tmp_path):
    """The map of the library's own compatibility rule, read from its compiled form."""
    normalizer = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    spec = pb.ModelProto.FromString(normalizer.serialized_model_proto()).normalizer_spec
    ours = pieces.Normalizer(pieces.char_map(spec.precompiled_charsmap), True, squeeze, True)
    for text in [*texts(), "Ａ ｶﾞ ﷺ ㍿", "ﬀ  ﬃ"]:
        got, begin, end = ours(text)
        assert got == normalizer.normalize(text), text
        assert len(begin) == len(end) == len(got.encode()) and (np.diff(begin) >= 0).all() and (begin <= end).all()


def test_longest_prefix_and_its_source():
    n = pieces.Normalizer({"a": "1", "ab": "22", "abc": "é"}, False, False, False)
    text, begin, end = n("xabcabda")
    assert text == "xé22d1"
    assert list(zip(begin, end)) == [(0, 1), (1, 4), (1, 4), (4, 6), (4, 6), (6, 7), (7, 8)]


def test_empty_table_and_size_limit(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_pieces(df, piece_model()).columns == ["doc_id", "text", *pieces.ADDED]
    assert pieces.encode_pieces(df, piece_model()).count() == 0
    monkeypatch.setattr(pieces, "MAX_MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        pieces.encode_pieces(df, piece_model())


def test_query(spark, sf_dir, proto):
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
