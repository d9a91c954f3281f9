"""General formal contexts: a relation of objects and attributes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import Dataset
from .quantize import Quantizer


class ClosureProvider(Protocol):
    def closure(self, attributes: Sequence[int]) -> DataFrame: ...


class ClosureSizeProvider(Protocol):
    def closure_size(self, attributes: Sequence[int]) -> int: ...


@dataclass(frozen=True)
class FormalContext:
    """``incidence`` has ``obj_id`` and ``attr_id``; the numbers of objects and attributes hold for those without pairs too."""

    incidence: DataFrame
    objects: int
    attributes: int

    def __post_init__(self) -> None:
        if self.objects < 1 or self.attributes < 1:
            raise ValueError("a context needs an object and an attribute")

    def set_incidence(self, obj: int, attr: int) -> FormalContext:
        if not (0 <= obj < self.objects and 0 <= attr < self.attributes):
            raise ValueError("no such object or attribute")
        pair = self.incidence.sparkSession.createDataFrame([(obj, attr)], self.incidence.select("obj_id", "attr_id").schema)
        return FormalContext(self.incidence.union(pair).distinct(), self.objects, self.attributes)

    def intension(self, obj: int) -> DataFrame:
        return self.incidence.where(F.col("obj_id") == obj).select("attr_id").distinct()

    def extension(self, attr: int) -> DataFrame:
        return self.incidence.where(F.col("attr_id") == attr).select("obj_id").distinct()

    def intensions(self) -> DataFrame:
        return self.incidence.groupBy("obj_id").agg(F.sort_array(F.collect_set("attr_id")).alias("attributes"))

    def extension_sizes(self) -> DataFrame:
        return self.incidence.groupBy("attr_id").agg(F.count_distinct("obj_id").alias("n"))

    def closure(self, attributes: Sequence[int], only: DataFrame | None = None) -> DataFrame:
        """The objects that have all attributes (relational division), of those in ``only`` (``obj_id``) if given.

        For no attribute these are all objects, ``0 .. objects - 1``.
        """
        wanted = sorted({*attributes})
        if wanted:
            held = self.incidence.where(F.col("attr_id").isin(wanted)).distinct()
            out = held.groupBy("obj_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("obj_id")
        else:
            out = self.incidence.sparkSession.range(self.objects).select(F.col("id").cast(self.incidence.schema["obj_id"].dataType).alias("obj_id"))
        return out if only is None else out.join(only, "obj_id", "left_semi")

    def closure_of(self, obj: int, only: DataFrame | None = None) -> DataFrame:
        return self.closure([r[0] for r in self.intension(obj).collect()], only)

    def closure_size(self, attributes: Sequence[int], only: DataFrame | None = None) -> int:
        return self.closure(attributes, only).count()

    def closure_size_of(self, obj: int, only: DataFrame | None = None) -> int:
        return self.closure_of(obj, only).count()

    def closure_sizes(self) -> DataFrame:
        """``obj_id`` and ``n``: the closure size of each object that has an attribute.

        Objects with equal attributes are one candidate, and a candidate is matched through its rarest attribute alone.
        """
        sets = self.incidence.groupBy("obj_id").agg(F.sort_array(F.collect_set("attr_id")).alias("own"))
        kinds = sets.groupBy("own").agg(F.count("*").alias("rows"))
        rare = self.incidence.distinct().groupBy("attr_id").agg(F.count("*").alias("holders"))
        first = kinds.select("own", F.explode("own").alias("attr_id")).join(rare, "attr_id").groupBy("own").agg(F.min_by("attr_id", F.struct("holders", "attr_id")).alias("attr_id"))
        other = kinds.select(F.col("own").alias("other"), "rows", F.explode("own").alias("attr_id"))
        sizes = first.join(other, "attr_id").where(F.size(F.array_except("own", "other")) == 0).groupBy("own").agg(F.sum("rows").alias("n"))
        return sets.join(sizes, "own").select("obj_id", "n")

    def same_as(self, other: FormalContext) -> bool:
        mine, theirs = (c.incidence.select("obj_id", "attr_id").distinct() for c in (self, other))
        return (self.objects, self.attributes) == (other.objects, other.attributes) and mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()

    def describe(self, objects: int = 10) -> str:
        rows = self.intensions().orderBy("obj_id").limit(objects).collect()
        return "\n".join([f"{self.objects} objects, {self.attributes} attributes", *(f"{r[0]}: {' '.join(map(str, r[1]))}" for r in rows)])

    def estimate_size(self) -> int:
        return 16 * self.incidence.count()

    def save(self, path: str) -> None:
        self.incidence.select("obj_id", "attr_id").write.mode("overwrite").parquet(f"{path}/incidence")
        self.incidence.sparkSession.createDataFrame([(self.objects, self.attributes)], "objects long, attributes long").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, spark: object, path: str) -> FormalContext:
        size = spark.read.parquet(f"{path}/size").first()
        return cls(spark.read.parquet(f"{path}/incidence"), size["objects"], size["attributes"])


def nominal_incidence(data: Dataset, quantizer: Quantizer) -> DataFrame:
    """A row for each object and feature: ``obj_id``, ``feature`` and the ``bin`` (as a string) that it has there."""
    quantizer.check(data)
    bins = quantizer.bins()
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), b.cast("string").alias("bin")) for i, b in enumerate(bins)])
    return data.df.select(F.col(data.id_col).alias("obj_id"), F.inline(cells))
