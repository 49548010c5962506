"""Building training sequences from id lists. All functions are Column -> Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Label of a position the loss leaves out.
IGNORE_INDEX = -100


@dataclass(frozen=True)
class Specials:
    """Ids of the special tokens and the first id left for ordinary ones."""

    pad: int = 0
    bos: int = 1
    eos: int = 2
    unk: int = 3
    mask: int = 4

    @property
    def first_free(self) -> int:
        return max(self.pad, self.bos, self.eos, self.unk, self.mask) + 1

    @property
    def structural(self) -> tuple[int, ...]:
        """Ids that never stand for text; an unknown word still does."""
        return tuple(sorted({self.pad, self.bos, self.eos, self.mask}))

    @property
    def names(self) -> dict[int, str]:
        return {self.pad: "<pad>", self.bos: "<s>", self.eos: "</s>", self.unk: "<unk>", self.mask: "<mask>"}


def as_col(value: Column | str | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def ids_of(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def repeat(value: int, times: Column) -> Column:
    """``value`` as a list of the given length; negative lengths give an empty list."""
    return F.array_repeat(F.lit(value), times.cast("int"))


def cut(ids: Column | str, length: Column | int) -> Column:
    """The first ``length`` entries, none for a length below one."""
    return F.slice(as_col(ids), F.lit(1), F.greatest(as_col(length).cast("int"), F.lit(0)))


def pad_right(ids: Column | str, length: Column | int, value: int) -> Column:
    ids = as_col(ids)
    return F.concat(ids, repeat(value, as_col(length) - F.size(ids)))


def add_special(ids: Column | str, sp: Specials, layout: str = "sentence") -> Column:
    """Specials around one sequence: ``[bos] a [eos]`` or, prefix layout, ``a [mask] [bos]``."""
    ids = as_col(ids)
    if layout == "sentence":
        return F.concat(ids_of(sp.bos), ids, ids_of(sp.eos))
    if layout == "prefix":
        return F.concat(ids, ids_of(sp.mask, sp.bos))
    raise ValueError(f"unknown layout {layout!r}")


def add_special_pair(a: Column | str, b: Column | str, sp: Specials) -> Column:
    """Source and target in the prefix layout: ``a [mask] [bos] b [eos]``."""
    return F.concat(add_special(a, sp, "prefix"), as_col(b), ids_of(sp.eos))


def special_mask(ids: Column | str, sp: Specials) -> Column:
    """1 where the id is a structural special, else 0."""
    return F.transform(as_col(ids), lambda x: x.isin(*sp.structural).cast("int"))


def mask_pad(labels: Column | str, pad: int) -> Column:
    """Labels equal to ``pad`` become ignored; a real token with that id is hidden as well."""
    return F.transform(as_col(labels), lambda x: F.when(x == pad, F.lit(IGNORE_INDEX)).otherwise(x))


def proportional_budget(source_len: Column, target_len: Column, max_length: int) -> tuple[Column, Column]:
    """Shares of ``max_length`` in proportion to the two lengths.

    A side that would get nothing keeps its own length and the other gets the rest. Two empty
    sides have no proportion; their budget is (0, max_length).
    """
    total = source_len + target_len
    share = F.when(total == 0, F.lit(0)).otherwise(
        (F.lit(max_length) * (source_len * F.lit(1.0) / F.when(total != 0, total))).cast("int")
    )
    s1 = F.when(share <= 0, source_len).otherwise(share)
    t1 = F.when(share <= 0, F.lit(max_length) - source_len).otherwise(F.lit(max_length) - share)
    return (
        F.when(t1 <= 0, F.lit(max_length) - target_len).otherwise(s1).cast("int"),
        F.when(t1 <= 0, target_len).otherwise(t1).cast("int"),
    )


def argmax(values: Column) -> Column:
    """0-based position of the first maximum of a number list."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_softmax_at(logits: Column, target: Column) -> Column:
    """Log-probability of ``target`` under the softmax of ``logits``, without overflow."""
    top = F.array_max(logits)
    spread = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.get(logits, target.cast("int")) - top - F.log(spread)


def take_field(structs: Column | str, name: str) -> Column:
    """One field of every struct in a list."""
    return F.transform(as_col(structs), lambda s: s[name])
