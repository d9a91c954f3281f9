"""Learned bins: one pass for all ranges, then pure expressions with the ranges as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import category, number, uniform_bin
from ..sources.dataset import Dataset


@dataclass(frozen=True)
class Quantizer:
    """``numeric``: (name, low, high, bins) of each numeric feature; ``categorical``: names, matched by value."""

    numeric: tuple[tuple[str, float | None, float | None, int], ...]
    categorical: tuple[str, ...]

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(x[0] for x in self.numeric) + self.categorical

    def bins(self) -> list[Column]:
        """The features' bins as ``b0``, ``b1``, ...; none is ever null."""
        made = [uniform_bin(*x) for x in self.numeric] + [category(c) for c in self.categorical]
        return [c.alias(f"b{i}") for i, c in enumerate(made)]

    def check(self, data: Dataset) -> None:
        """The features must be there by name; their order in ``data`` doesn't matter."""
        for what, own, given in (("numeric", tuple(x[0] for x in self.numeric), data.numeric), ("categorical", self.categorical, data.categorical)):
            if set(own) != set(given):
                raise ValueError(f"the model was fitted on the {what} features {sorted(own)}, not {sorted(given)}")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: Mapping) -> Quantizer:
        return cls(tuple(tuple(x) for x in d["numeric"]), tuple(d["categorical"]))


def fit_quantizer(data: Dataset, n: int | Mapping[str, int] = 32, default: int = 32) -> Quantizer:
    """``n`` bins for each numeric feature, or by name with ``default`` for the rest."""
    count = lambda c: n.get(c, default) if isinstance(n, Mapping) else n
    if any(count(c) < 1 for c in data.numeric):
        raise ValueError("a feature needs one bin at least")
    if not data.numeric:
        return Quantizer((), data.categorical)
    row = data.df.agg(*[f(number(c)).alias(f"{p}{k}") for k, c in enumerate(data.numeric) for p, f in (("low", F.min), ("high", F.max))]).first()
    return Quantizer(tuple((c, row[f"low{k}"], row[f"high{k}"], count(c)) for k, c in enumerate(data.numeric)), data.categorical)
