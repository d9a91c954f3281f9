"""Which feature sets a model looks at, in which order, and what they are called."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FeatureSet = tuple[int, ...]


class Selector(Protocol):
    """Yields the feature sets for a number of features."""

    def __call__(self, features: int) -> list[FeatureSet]: ...


def singletons(features: int) -> list[FeatureSet]:
    return [(i,) for i in range(features)]


def doubletons(features: int) -> list[FeatureSet]:
    """All pairs ``i <= j``, so the singletons too."""
    return [(i,) if i == j else (i, j) for i in range(features) for j in range(i, features)]


@dataclass(frozen=True)
class ConfigurableSelector:
    """Pairs if asked for, else singletons if asked for; then the full set. Repeated sets count twice."""

    singletons: bool = True
    doubletons: bool = True
    full: bool = True

    def __call__(self, features: int) -> list[FeatureSet]:
        sets = doubletons(features) if self.doubletons else singletons(features) if self.singletons else []
        if self.full:
            sets = [*sets, tuple(range(features))]
        if not sets:
            raise ValueError("no feature set: ask for singletons, doubletons or the full set")
        return sets


#: Explorers suggest further feature sets once a model is trained: from the number of features, the place of the first set
#: that came last, all sets so far, and their weights. The model is then trained on all, until nothing is suggested.
Explorer = Callable[[int, int, list[FeatureSet], Sequence[float]], list[FeatureSet]]
EXPLORERS: dict[str, Explorer] = {"none": lambda features, start, sets, weights: []}


def name_of(features: FeatureSet, names: Sequence[str]) -> str:
    """``full`` for all features, ``{}`` for none, else the names in braces."""
    if len(features) >= len(names):
        return "full"
    return f"{{ {', '.join(feature_name(i, names) for i in features)} }}" if features else "{}"


def feature_name(i: int, names: Sequence[str]) -> str:
    return names[i] or f"att{i}"


def as_frame(spark: SparkSession, sets: Sequence[FeatureSet], names: Sequence[str]) -> DataFrame:
    """``ctx_id``, ``features`` and ``feature_set`` of each set."""
    return spark.createDataFrame([(k, list(s), name_of(s, names)) for k, s in enumerate(sets)], "ctx_id int, features array<int>, feature_set string")


def pairs_of(features: DataFrame) -> DataFrame:
    """The same pairs from a table with the column ``i``: a theta self-join over features, never over rows."""
    a, b = features.select(F.col("i").alias("i")), features.select(F.col("i").alias("j"))
    return a.join(F.broadcast(b), F.col("i") <= F.col("j"))
