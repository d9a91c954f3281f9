"""Plans that hold at any size: ranks in ranges, one hot label, large sets looked up together, names that clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.operators import classifier, training
from latticeflow.operators import closures as closure_ops
from latticeflow.operators.quantize import fit_quantizer
from latticeflow.sources import dataset
from latticeflow.sources.dataset import Dataset, factorize, range_of, stratified_folds


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp"])
def test_ranks_equal_those_of_one_task(spark, monkeypatch, kind):
    monkeypatch.setattr(dataset, "RANGES", 7)
    monkeypatch.setattr(dataset, "SAMPLED", 40)
    rng = np.random.default_rng(0)
    rows = [(int(k), None if v == 13 else f"v{v}") for k, v in enumerate(rng.integers(0, 90, 600))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v string").withColumn("at", F.col("k").cast(kind) if kind != "string" else F.format_string("%05d", "k"))
    want, seen = {}, {}
    for k, v in sorted(rows):
        want[k] = -1 if v is None else seen.setdefault(v, len(seen))
    assert {r["k"]: r["code"] for r in factorize(df, "v", "at").collect()} == want


def test_a_hot_label_is_several_tasks(spark):
    df = spark.range(20_000).withColumn("label", F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit(7)).cast("int")).withColumn("order", F.lit("x"))
    ranges = df.withColumn("r", range_of(df, "id")).groupBy("label", "r").count().collect()
    assert len(ranges) > 300 and max(r["count"] for r in ranges) < 400
    folds = stratified_folds(df, "label", F.col("id"), "id", 4)
    assert folds.columns == ["id", "label", "order", "fold"]
    got = {r["id"]: r["fold"] for r in folds.collect()}
    for own in ([k for k in range(20_000) if k % 50], [*range(0, 20_000, 50)]):
        assert [got[k] for k in own] == [n % 4 for n in range(len(own))]


def test_folds_of_empty_and_constant_frames(spark):
    df = spark.createDataFrame([(k, 1, "a") for k in range(5)], "id long, x int, y string")
    data = Dataset(df.limit(0), "id", ("x",), label="y")
    assert data.folds(3, stratified=True).count() == 0 and data.folds(3).count() == 0
    assert factorize(df.limit(0), "y", "id").count() == 0
    assert {r["code"] for r in factorize(df, "y", "x").collect()} == {0}
    assert sorted(r["fold"] for r in Dataset(df, "id", ("x",), label="y").folds(3, stratified=True).collect()) == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("alone", [0, 1, 100])
def test_large_sets_together(spark, monkeypatch, alone):
    """Whatever way a set takes, the counts are the same; more large sets need no more exchanges of rows."""
    df = spark.range(400).selectExpr("id", "id % 7 as a", "id % 5 as b", "cast(id % 3 as string) as c", "if(id % 11 = 0, null, cast(id % 4 as string)) as d")
    data = Dataset(df, "id", ("a", "b"), ("c", "d"))
    sets = [(0,), (1,), (2,), (0, 2), (1, 3), (0, 1, 2), (0, 1, 2, 3)]
    quantizer = fit_quantizer(data, 5)
    count = lambda: {r["id"]: r["sizes"] for r in closure_ops.sizes_of(data, closure_ops.build(data, quantizer, sets, {"n": F.lit(1)}), "n").collect()}
    want = count()
    monkeypatch.setattr(closure_ops, "DENSE", 0)
    monkeypatch.setattr(closure_ops, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(closure_ops, "ALONE", alone)
    assert count() == want


def test_sixty_four_features(spark):
    df = spark.range(50).select("id", *[(F.col("id") % (k % 3 + 2)).alias(f"f{k}") for k in range(64)])
    data = Dataset(df, "id", tuple(f"f{k}" for k in range(64)))
    sets = [(0,), (63,), (0, 63), tuple(range(64))]
    built = closure_ops.build(data, fit_quantizer(data, 4), sets, {"n": F.lit(1)})
    got = {r["id"]: r["sizes"] for r in closure_ops.sizes_of(data, built, "n").collect()}
    rows = [[k % (f % 3 + 2) for f in range(64)] for k in range(50)]
    assert got == {k: [sum(all(rows[k][f] == x[f] for f in s) for x in rows) for s in sets] for k in range(50)}


def test_an_epoch_sends_few_rows_to_the_driver(spark):
    """However many partitions the training rows have: F1 of the third round."""
    rng = np.random.default_rng(1)
    scores, y, n = rng.uniform(0, 1, (500, 6)), rng.integers(0, 3, 500), rng.integers(1, 9, 500)
    w = rng.normal(0, 1, (3, 6))
    made = [(s.tolist(), int(a), int(b)) for s, a, b in zip(scores, y, n, strict=True)]
    rows = spark.createDataFrame(made, "scores array<double>, y int, n long").repartition(90).persist()
    assert rows.count() == 500
    context = spark.sparkContext
    context.setJobGroup("epoch", "an epoch")
    loss, gradient = classifier._on_cluster(rows, w)
    context.setJobGroup("other", "others")
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("epoch")]
    stages = [tracker.getStageInfo(k) for j in jobs for k in j.stageIds]
    done = sorted((x.stageId, x.numCompletedTasks) for x in stages if x and x.numCompletedTasks)
    rows.unpersist()
    assert done[-1][1] <= training.MERGERS
    assert sum(x for _, x in done) <= training.MERGERS + classifier.TASKS_A_CORE * context.defaultParallelism
    want = classifier._cross_entropy(w, scores, y, n.astype(float))
    assert loss == pytest.approx(want[0]) and gradient == pytest.approx(want[1])


def test_wide_scores_train_on_the_cluster(spark, monkeypatch):
    """A few rows with very many scores aren't collected either."""
    df = spark.range(60).selectExpr("id", "id % 7 as a", "id % 5 as b", "cast(id % 3 as int) as y")
    data = Dataset(df, "id", ("a", "b"), label="y")
    fit = lambda: classifier.CNClassifier(n=4, epochs=3).fit(data).weights
    calls, sums = [], classifier._on_cluster
    monkeypatch.setattr(classifier, "_on_cluster", lambda *a: calls.append(1) or sums(*a))
    want = fit()
    assert not calls
    monkeypatch.setattr(classifier, "LOCAL_SCORES", 100)
    assert fit() == pytest.approx(want) and calls
