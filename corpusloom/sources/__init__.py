"""Readers and writers."""

from corpusloom.sources.files import read_csv, read_jsonl, read_named, read_splits, read_text
from corpusloom.sources.sinks import materialize, write_jsonl, write_metrics
from corpusloom.sources.vocab_files import read_vocab, write_vocab

__all__ = [
    "materialize",
    "read_csv",
    "read_jsonl",
    "read_named",
    "read_splits",
    "read_text",
    "read_vocab",
    "write_jsonl",
    "write_metrics",
    "write_vocab",
]
