"""Explanations: feature sets by how much they say for a prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.feature_sets import FeatureSet, name_of


@dataclass(frozen=True)
class Explanation:
    """``frame`` has the id, ``prediction`` and ``relevances`` (an array in the order of ``sets``)."""

    frame: DataFrame
    id_col: str
    sets: Sequence[FeatureSet]
    names: Sequence[str]

    def predictions(self) -> DataFrame:
        return self.frame.select(self.id_col, "prediction")

    def _ranked(self, top: int | None) -> DataFrame:
        labels = F.array(*[F.lit(name_of(s, self.names)) for s in self.sets])
        entries = F.transform("relevances", lambda v, k: F.struct((-v).alias("order"), k.alias("ctx_id"), F.element_at(labels, k + 1).alias("feature_set"), v.alias("relevance")))
        ranked = F.sort_array(entries)  # most relevant first; equals in the order of the sets
        return self.frame.select(self.id_col, "prediction", (F.slice(ranked, 1, top) if top else ranked).alias("entries"))

    def entries(self, top: int | None = None) -> DataFrame:
        """A row for each id and feature set with its ``rank`` from 1; ranked within the row, so nothing is shuffled."""
        return self._ranked(top).select(self.id_col, "prediction", F.posexplode("entries").alias("place", "e")).select(
            self.id_col, "prediction", (F.col("place") + 1).alias("rank"), F.col("e.ctx_id").alias("ctx_id"), F.col("e.feature_set").alias("feature_set"), F.col("e.relevance").alias("relevance")
        )

    def __getitem__(self, row_id: object) -> list[tuple[str, float]]:
        rows = self._ranked(None).where(F.col(self.id_col) == F.lit(row_id)).collect()
        if not rows:
            raise KeyError(row_id)
        return [(e["feature_set"], e["relevance"]) for e in rows[0]["entries"]]

    def iterate(self, row_id: object) -> Iterator[tuple[str, float]]:
        yield from self[row_id]

    def to_string(self, row_id: object) -> str:
        """The prediction and the three most relevant sets; dots if there are more sets than features."""
        row = self.frame.where(F.col(self.id_col) == F.lit(row_id)).select("prediction").first()
        every = self[row_id]
        best = every[:3]
        shown = ", ".join(f"{name}: {value}" for name, value in best)
        return f"{row['prediction']}: {shown}{'...' if len(best) > len(self.names) else ''}"
