"""SentencePiece encoding with byte spans in the original text, and decoding.

The normaliser is read from the model: its compiled character map (a double-array trie of keys and
the texts that replace them) is applied by longest prefix, blanks are escaped, the dummy prefix is
added. Each byte of the normalised text remembers the bytes of the original it stands for, so
every piece is projected to a span of the original text. The normalised text is cut where no piece
of the vocabulary can cross; the distinct parts of a run of texts are found by Arrow, and each part
is encoded once per task by the library's own merge procedure (a model that allows no such cuts
encodes its texts whole). The spans of a run are computed together.

Defined cases: null text is empty; an empty text has only the begin and end ids, with empty spans;
extra columns stay, and those that clash with the added ones are replaced; rows are independent,
so ties and repeated rows need no rule, and an empty table stays empty. A text is handled whole.
The model must be at most ``MAX_MODEL_BYTES`` since it is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.common import text_of, without

MAX_MODEL_BYTES = 64 << 20
MARK = "▁"
RUN_SIZE, CACHED_PARTS = 1 << 21, 200_000
ADDED = ("ids", "starts", "ends", "decoded")
TYPES = {
    "ids": "array<int>",
    "starts": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def char_map(blob: bytes) -> dict[str, str]:
    """Key -> replacement of a compiled character map.

    The blob is the byte length of the trie, its 32-bit units, then the replacements, each ended
    by a zero byte. A unit holds a label, an offset to its children and whether a value is below.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    found, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        base = at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
        if key and units[at] & 256:
            begin = int(units[base] & 0x7FFFFFFF)
            found[key.decode("utf-8", "replace")] = texts[begin : texts.index(0, begin)].decode()
        near = base ^ labels
        near, label = near[near < len(units)], labels[near < len(units)]
        for child, c in zip(near[(units[near] & 0x800000FF) == label], label[(units[near] & 0x800000FF) == label]):
            todo.append((int(child), key + bytes([c])))
    return found


class Normalizer:
    """Longest-prefix normalisation that keeps the source of every byte."""

    def __init__(self, mapping: dict[str, str], prefix: bool, squeeze: bool, escape: bool):
        self.mapping, self.prefix, self.squeeze, self.escape = mapping, prefix, squeeze, escape
        self.longest: dict[str, int] = {}
        for key in mapping:
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))
        heads = "".join(map(re.escape, self.longest))
        self.head = re.compile(f"[{heads}]") if heads else None

    def _units(self, text: str) -> Iterator[tuple[str, str]]:
        """(source, replacement) from left to right."""
        at = 0
        while self.head and (m := self.head.search(text, at)):
            i = m.start()
            if at < i:
                yield text[at:i], text[at:i]
            for n in range(min(self.longest[text[i]], len(text) - i), 0, -1):
                if (to := self.mapping.get(text[i : i + n])) is not None:
                    yield text[i : i + n], to
                    break
            else:
                n = 1
                yield text[i], text[i]
            at = i + n
        if at < len(text):
            yield text[at:], text[at:]

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and per byte of it the begin and end of its source in bytes."""
        out, begins, ends, at = [], [], [], 0
        for source, to in self._units(text):
            raw, made = source.encode(), to.encode()
            if source is to or source == to:
                span = np.arange(at, at + len(raw), dtype=np.int32)
                begins.append(span)
                ends.append(span + 1)
            else:
                begins.append(np.full(len(made), at, np.int32))
                ends.append(np.full(len(made), at + len(raw), np.int32))
            out.append(to)
            at += len(raw)
        text = "".join(out)
        begin = np.concatenate(begins) if begins else np.empty(0, np.int32)
        end = np.concatenate(ends) if ends else np.empty(0, np.int32)
        raw = np.frombuffer(text.encode(), np.uint8)
        if self.squeeze and len(raw):
            blank = raw == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            last = np.flatnonzero(keep & ~blank)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            raw, begin, end = raw[keep], begin[keep], end[keep]
            text = raw.tobytes().decode()
        if not text:
            return "", begin, end
        if self.escape:
            times = np.where(raw == 32, len(MARK.encode()), 1)
            text, begin, end = text.replace(" ", MARK), np.repeat(begin, times), np.repeat(end, times)
        if self.prefix:
            mark = MARK if self.escape else " "
            first = np.full(len(mark.encode()), begin[0], np.int32)
            text, begin, end = mark + text, np.concatenate([first, begin]), np.concatenate([first, end])
        return text, begin, end


class PieceCodec:
    """One model in a worker: encodes normalised parts, projects pieces, decodes."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec, pieces = model.normalizer_spec, model.pieces
        self.normalize = Normalizer(
            char_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        )
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # The same vocabulary and merges over text that is normalised already.
        plain = sentencepiece_model_pb2.ModelProto()
        plain.CopyFrom(model)
        plain.normalizer_spec.Clear()
        plain.normalizer_spec.name = "identity"
        plain.normalizer_spec.add_dummy_prefix = False
        plain.normalizer_spec.remove_extra_whitespaces = False
        plain.normalizer_spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        byte = type(pieces[0]).Type.Value("BYTE") if len(pieces) else 6
        self.bytes_of = np.array([1 if p.type == byte else len(p.piece.encode()) for p in pieces], np.int32)
        self.unknown = self.library.unk_id()
        own = type(pieces[0]).Type.Value("USER_DEFINED") if len(pieces) else 4
        self.in_parts = (
            spec.escape_whitespaces
            and model.trainer_spec.byte_fallback
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == own or MARK in p.piece.lstrip(MARK) for p in pieces)
        )
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.known: dict[str, list[int]] = {}

    def _lengths(self, text: str, ids: np.ndarray) -> np.ndarray:
        sizes = self.bytes_of[ids]
        if (ids == self.unknown).any():  # an unknown piece is as long as its text
            sizes = np.array([len(p.encode()) for p in self.merger.encode(text, out_type=str)], np.int32)
        return sizes

    def _merged(self, normal: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts one after another, and how many each has; ``sizes`` are in bytes."""
        if not self.in_parts:
            found = self.merger.encode(normal, num_threads=1)
            counts = np.array([len(f) for f in found], np.int64)
            return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts
        raw = np.frombuffer("".join(normal).encode(), np.uint8)
        ends = np.cumsum(sizes)
        first, second, third = MARK.encode()
        mark = np.zeros(len(raw) + 3, bool)  # shifted by three: whether the sign begins at a byte
        mark[3:-2] = (raw[:-2] == first) & (raw[1:-1] == second) & (raw[2:] == third)
        begins = mark[3:] & ~mark[:-3]
        begins[(ends - sizes)[sizes > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(raw)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        if len(self.known) >= CACHED_PARTS:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        self.known.update(zip(new, self.merger.encode(new, num_threads=1)))
        ids = pa.array([self.known[p] for p in distinct], pa.list_(pa.int32())).take(parts.indices)
        at = ids.offsets.to_numpy().astype(np.int64)[np.searchsorted(cuts, np.concatenate([[0], ends]))]
        return ids.values.to_numpy(), np.diff(at)

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids of all texts, one after another, the byte span of each, and where texts begin."""
        normal = [self.normalize(t) for t in texts]
        sizes = np.array([len(b) for _, b, _ in normal], np.int64)
        inner, counts = self._merged([n for n, _, _ in normal], sizes) if sizes.any() else (np.zeros(0, np.int32), sizes)
        lengths = self.bytes_of[inner].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        if self.unknown >= 0:
            for i in np.unique(np.searchsorted(cuts, np.flatnonzero(inner == self.unknown), "right") - 1):
                lengths[cuts[i] : cuts[i + 1]] = self._lengths(normal[i][0], inner[cuts[i] : cuts[i + 1]])
        if (np.add.reduceat(np.append(lengths, 0), cuts[:-1])[counts > 0] != sizes[counts > 0]).any() or sizes[counts == 0].any():
            raise ValueError("the pieces do not cover the normalised text")
        stops = np.cumsum(lengths)
        begin, end = (np.concatenate([n[k] for n in normal]) if normal else np.zeros(0, np.int32) for k in (1, 2))
        whole = cuts + 2 * np.arange(len(cuts))  # with a begin and an end id for every text
        place = np.arange(len(inner)) + 2 * np.repeat(np.arange(len(texts)), counts) + 1
        ids, starts, ends = (np.zeros(whole[-1], np.int32) for _ in range(3))
        ids[place], starts[place], ends[place] = inner, begin[stops - lengths], end[stops - 1]
        bytes_ = [len(t.encode()) for t in texts]
        ids[whole[:-1]], ids[whole[1:] - 1] = self.bos, self.eos
        starts[whole[1:] - 1], ends[whole[1:] - 1] = bytes_, bytes_
        return ids, starts, ends, whole

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end id, and the byte span of each."""
        ids, starts, ends, cuts = self.encode_run(texts)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b], starts[a:b], ends[a:b]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([i.tolist() for i in ids], num_threads=1)


def runs(texts: Sequence[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``RUN_SIZE`` characters together."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN_SIZE:
            yield run
            run, size = [], 0
    if run:
        yield run


def hex_digests(values: Sequence[bytes]) -> list[str]:
    return [hashlib.sha256(v).hexdigest() for v in values]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file; a path with a scheme is read by Spark."""
    if "://" in path:
        proto = bytes(spark.read.format("binaryFile").load(path).first().content)
    else:
        with open(path, "rb") as file:
            proto = file.read()
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has {len(proto)} bytes; at most {MAX_MODEL_BYTES} are broadcast")
    return proto


def encode_pieces(docs: DataFrame, model: str, text: str = "text", added: Sequence[str] = ADDED) -> DataFrame:
    """``docs`` with the columns ``added``.

    ids, starts, ends (array<int>) and decoded (string); or digests made where the ids are, so that
    the lists need not leave the worker: n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (UTF-8).
    """
    spark = docs.sparkSession
    proto = spark.sparkContext.broadcast(read_model(spark, model))
    added = list(added)

    @F.arrow_udf("struct<" + ", ".join(f"{c}: {TYPES[c]}" for c in added) + ">")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(proto.value)
        # A batch is handed back in parts, so only the arrays of one part exist at a time.
        for batch in batches:
            for texts in runs(batch.to_pylist()):
                ids, starts, ends, cuts = codec.encode_run(texts)
                each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                decoded = codec.decode(each)
                offsets = pa.array(cuts, pa.int32())
                made = {
                    "ids": lambda: pa.ListArray.from_arrays(offsets, pa.array(ids)),  # noqa: B023
                    "starts": lambda: pa.ListArray.from_arrays(offsets, pa.array(starts)),  # noqa: B023
                    "ends": lambda: pa.ListArray.from_arrays(offsets, pa.array(ends)),  # noqa: B023
                    "decoded": lambda: pa.array(decoded, pa.string()),  # noqa: B023
                    "n_tokens": lambda: pa.array(np.diff(cuts)),  # noqa: B023
                    "ids_sha256": lambda: pa.array(hex_digests([i.astype("<u4").tobytes() for i in each])),  # noqa: B023
                    "decoded_sha256": lambda: pa.array(hex_digests([d.encode() for d in decoded])),  # noqa: B023
                }
                yield pa.StructArray.from_arrays([made[c]() for c in added], added)

    out = without(docs, *added, "__pieces").withColumn("__pieces", encoded(text_of(text)))
    return out.select("*", *[F.col(f"__pieces.{c}").alias(c) for c in added]).drop("__pieces")
