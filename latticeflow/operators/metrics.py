"""Area under the ROC curve by rank sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of scores that are ranked on their own.
RANGES = 200


def auc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """``n_pos``, ``n_neg`` and ``auc``: how likely a positive row (label not 0) outscores a negative one; ties count half.

    Scores are counted by value, values fall into ranges, and a range starts from the negatives of those below it, so
    no single task orders all scores.
    """
    counted = frame.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) != 0).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cuts = counted.agg(F.percentile_approx("s", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts"))
    placed = counted.crossJoin(F.broadcast(cuts)).select("s", "pos", "neg", F.size(F.filter("cuts", lambda c: c < F.col("s"))).alias("range"))
    sums = placed.groupBy("range").agg(F.sum("neg").alias("range_neg"))
    starts = sums.select("range", F.coalesce(F.sum("range_neg").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # RANGES rows
    within = F.coalesce(F.sum("neg").over(W.partitionBy("range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = placed.withColumn("within", within).join(F.broadcast(starts), "range")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("within") + F.col("neg") / 2))
    return below.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")).select("n_pos", "n_neg", F.try_divide("wins", F.col("n_pos") * F.col("n_neg")).alias("auc"))
