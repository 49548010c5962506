"""Text columns: word splitting, blank test, strip."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns.
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The characters for which Python's str.isspace() holds. (?U) makes \s the Unicode
# White_Space class; the four separators below count as blank in Python only.
SPACE = r"[\s\x1c-\x1f]"


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, and every other visible character alone."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def byte_level_words(text: Column | str) -> Column:
    """Pieces of the byte-level split: the blank stays in front of its word, nothing is lost.

    Unicode classes are switched on so that blanks and letters agree with Python's ``regex``.
    """
    return F.regexp_extract_all(text, F.lit(f"(?U)({BYTE_LEVEL_PATTERN})"), F.lit(1))


def is_blank(text: Column | str) -> Column:
    """Empty, or nothing but white space."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(f"(?U)^{SPACE}*$")


def strip(text: Column) -> Column:
    """Remove white space of any kind on both ends; ``trim`` would remove blanks only."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def non_empty(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.isNotNull() & (text != "")


def join_ids(ids: Column | str) -> Column:
    """An id list as text, ``"5 17 3"``; nulls in the list are written as ``_``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(ids.cast("array<string>"), " ", "_")
