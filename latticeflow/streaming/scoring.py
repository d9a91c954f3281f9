"""Scoring and counting of streams, with frozen bins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closures import bin_names, tuple_counts
from ..operators.outlier import SODModel, UODModel
from ..operators.quantize import Quantizer
from ..sources.dataset import Dataset


def score_stream(model: UODModel | SODModel, stream: Dataset) -> DataFrame:
    """The id and score of each row of a stream: stream-static joins, without state."""
    if not model._fitted().wide:
        raise ValueError("so many feature sets need an aggregation; score in foreachBatch")
    return model.predict(stream)


def count_stream(stream: Dataset, quantizer: Quantizer, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Running counts of the tuples of bins; for the update or complete mode."""
    return tuple_counts(stream, quantizer, counts or {"n": F.lit(1)})


def windowed_counts(stream: Dataset, quantizer: Quantizer, time: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of the tuples of bins by window of time; rows later than ``late`` are left out."""
    names = bin_names(len(quantizer.features))
    window = F.window(time, length, slide) if slide else F.window(time, length)
    binned = stream.df.withWatermark(time, late).select(F.col(time), *quantizer.bins())
    return binned.groupBy(window.alias("span"), *names).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *names, "n")


def merge_counts(old: DataFrame, new: DataFrame, features: int) -> DataFrame:
    """The counts of both: counts add up, so a model grows without a look at its old rows."""
    names = bin_names(features)
    counts = [c for c in old.columns if c not in names]
    return old.unionByName(new).groupBy(*names).agg(*[F.sum(c).alias(c) for c in counts])


def maintain(stream: Dataset, quantizer: Quantizer, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the tuple counts of a stream in ``path``, one version for each batch (``version=<batch>``).

    A repeated batch writes its own version anew from the one before, so counts are exact after a failure.
    """
    features = len(quantizer.features)

    def merge(batch: DataFrame, version: int) -> None:
        new = tuple_counts(stream.with_frame(batch), quantizer, {"n": F.lit(1)})
        if version:
            new = merge_counts(batch.sparkSession.read.parquet(f"{path}/version={version - 1}"), new, features)
        new.write.mode("overwrite").parquet(f"{path}/version={version}")

    return stream.df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
