"""Loading, roles, splits, contexts, sets, metrics and streams."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeflow.functions import scalar
from latticeflow.operators.context import FormalContext
from latticeflow.operators.metrics import auc
from latticeflow.operators.outlier import UODModel
from latticeflow.operators.quantize import fit_quantizer
from latticeflow.plans import feature_sets as sets
from latticeflow.sources import loaders
from latticeflow.sources.dataset import Dataset, factorize
from latticeflow.sources.loaders import load
from latticeflow.streaming import scoring

#: The known fixtures' table.
FRUIT = pd.DataFrame({"diameter": [3.5, 4.5, 5.3, 6.5, 2.1], "color": ["green", "red", "green", "green", "yellow"], "delicious": ["yes", "yes", "yes", "yes", "no"]})


def labels(data):
    return [r[data.label] for r in data.df.orderBy(data.id_col).collect()]


def test_pandas_roles(spark):
    d = load(FRUIT, labels="delicious")
    assert (d.numeric, d.categorical, d.label, labels(d)) == (("diameter",), ("color",), "delicious", [0, 0, 0, 0, 1])
    d = load(FRUIT, labels="delicious", y=np.array([1, 0, 1, 1, 0]))
    assert (d.numeric, d.label, labels(d)) == (("diameter",), "delicious", [1, 0, 1, 1, 0])
    d = load(pd.DataFrame({"feat": [1, 1, 1, 1, 0]}), categorical="feat")
    assert (d.numeric, d.categorical, d.label, d.size()) == ((), ("feat",), None, 5)
    with_label = load(pd.DataFrame({"a": [1.0, 2.0], "o": [0, 1]}), labels="o", y=[1, 0])
    assert with_label.features == ("a",) and labels(with_label) == [1, 0]
    typed = load(pd.DataFrame({"b": [True, False], "k": pd.Categorical(["x", None])}))
    assert typed.categorical == ("b", "k")


def test_refused(spark):
    for error, f in (
        (ValueError, lambda: load({})),
        (TypeError, lambda: load(FRUIT, labels=["delicious"])),
        (ValueError, lambda: load(FRUIT, labels="none")),
        (ValueError, lambda: load(None)),
        (ValueError, lambda: load(np.zeros(3))),
        (ValueError, lambda: load(np.zeros((3, 1)), y=[1])),
        (ValueError, lambda: load("/tmp/x.unknown")),
        (OSError, lambda: load("/tmp/absent-file.csv")),
        (ValueError, lambda: Dataset(spark.range(1), "id")),
    ):
        with pytest.raises(error):
            f()


def test_numpy(spark):
    d = load(np.array([[2.0, 3.25], [9.5, 1.33]], np.float32), Xc=np.array([[1], [0]], np.int8), y=np.array([[0], [1]]))
    kinds = dict(d.df.dtypes)
    assert kinds["x0"] == "double" and kinds["c0"] == "int" and kinds["label"] == "int"


def test_files(spark, tmp_path):
    FRUIT.to_csv(tmp_path / "f.csv", index=False)
    FRUIT.to_json(tmp_path / "f.json")
    FRUIT.to_json(tmp_path / "g.json", orient="records")
    FRUIT.to_json(tmp_path / "h.jsonl", orient="records", lines=True)
    FRUIT.to_parquet(tmp_path / "f.parquet")
    FRUIT.to_csv(tmp_path / "s.csv", index=False, sep=";")
    spark.createDataFrame(FRUIT).createOrReplaceTempView("fruit")
    (tmp_path / "f.sql").write_text("SELECT *\nFROM fruit")
    want = sorted(map(tuple, FRUIT[["diameter", "color"]].values.tolist()))
    for name, settings in (("f.csv", {}), ("f.json", {}), ("g.json", {}), ("h.jsonl", {}), ("f.parquet", {}), ("f.sql", {}), ("s.csv", {"parse": {"sep": ";"}})):
        d = load(f"{tmp_path}/{name}", labels="delicious", settings=settings)
        assert sorted(tuple(r) for r in d.df.select("diameter", "color").collect()) == want, name
        assert d.categorical == ("color",)


def test_own_loader(spark, monkeypatch):
    class Mine:
        pass

    monkeypatch.setitem(loaders.loaders, Mine, lambda data, **_: load(FRUIT))
    assert load(Mine()).numeric == ("diameter",)


def test_names(spark):
    d = load(FRUIT, labels="delicious")
    assert d.set_real_names(["size"]).numeric == ("size",)
    assert d.set_categorical_names({"hue": 0}).categorical == ("hue",)
    assert d.set_labels_name("good").label == "good"
    for error, bad in ((TypeError, "x"), (RuntimeError, ["a", "b"]), (RuntimeError, {"a": 4})):
        with pytest.raises(error):
            d.set_real_names(bad)
    assert d.feature_name(1) == "color" and d.feature_set_to_str((0, 1)) == "full" and d.feature_set_to_str((1,)) == "{ color }"
    assert sets.name_of((), ["a"]) == "{}" and sets.feature_name(2, ["a", "b", ""]) == "att2" and sets.name_of((0,), ["a"]) == "full"


class Splits:
    def split(self, X, y=None):
        yield [1, 2], [0]
        yield [0, 2], [1]
        yield [0], [1, 2]


def test_splits(spark):
    d = load(np.array([[2.1], [2.6], [3.1]]), Xc=np.array([[2], [0], [1]]), y=np.array([0, 1, 0]))
    got = [[[tuple(r)[1:] for r in part.df.orderBy("row_id").collect()] for part in pair] for pair in d.split(Splits())]
    rows = [(2.1, 2, 0), (2.6, 0, 1), (3.1, 1, 0)]
    assert got == [[[rows[k] for k in a], [rows[k] for k in b]] for a, b in Splits().split(None)]
    many = load(spark.range(500).selectExpr("id", "id * 1.0 as v", "cast(id % 5 = 0 as int) as y"), id_col="id", labels="y")
    for stratified in (False, True):
        seen = []
        for train, test in many.kfold(4, stratified=stratified):
            ids = {r["id"] for r in test.df.collect()}
            assert not ids & {r["id"] for r in train.df.collect()}
            seen += ids
            if stratified:
                assert test.df.where("y = 1").count() == 25
        assert sorted(seen) == [*range(500)]


def test_selectors():
    assert sets.ConfigurableSelector(singletons=False)(2) == [(0,), (0, 1), (1,), (0, 1)]
    assert sets.ConfigurableSelector(doubletons=False)(2) == [(0,), (1,), (0, 1)]
    assert len(sets.ConfigurableSelector()(6)) == 22


def test_factorize(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, v string")
    assert [r["code"] for r in factorize(df, "v", "id").orderBy("id").collect()] == [0, -1, 1, 0]


PAIRS = {0: [2, 4, 11], 1: [5, 7, 8, 10], 2: [1, 3, 5, 6, 9], 3: [5, 9]}


def context(spark, pairs, objects, attributes):
    return FormalContext(spark.createDataFrame([(o, a) for o, x in pairs.items() for a in x], "obj_id int, attr_id int"), objects, attributes)


def test_small_context(spark, tmp_path):
    c = context(spark, PAIRS, 4, 12)
    assert (c.closure_size_of(3), c.closure_size_of(0), c.closure_size([])) == (2, 1, 4)
    assert sorted(r[0] for r in c.closure([5]).collect()) == [1, 2, 3]
    assert c.closure_size([5], c.extension(9)) == 2
    assert {r["obj_id"]: r["n"] for r in c.closure_sizes().collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert {r["attr_id"]: r["n"] for r in c.extension_sizes().collect()}[5] == 3
    c.save(f"file://{tmp_path}/c")
    assert FormalContext.load(spark, f"file://{tmp_path}/c").same_as(c)
    assert not c.set_incidence(0, 0).same_as(c) and c.set_incidence(0, 2).same_as(c)
    assert "4 objects" in c.describe() and c.estimate_size() > 0
    with pytest.raises(ValueError):
        FormalContext(c.incidence, 0, 1)


def test_random_contexts(spark):
    rng = np.random.default_rng(0)
    pairs = {o: sorted({*rng.integers(0, 6, rng.integers(1, 5)).tolist()}) for o in range(25)}
    got = {r["obj_id"]: r["n"] for r in context(spark, pairs, 25, 6).closure_sizes().collect()}
    assert got == {o: sum({*x} <= {*z} for z in pairs.values()) for o, x in pairs.items()}


def test_sets(spark):
    df = spark.createDataFrame([([15, 16, 21, 75, 111], [16, 75]), ([], [])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    row = df.select(scalar.intersect(a, b), scalar.subset_of(b, a), scalar.proper_subset_of(b, a), scalar.same_set(a, b), scalar.set_size(a), scalar.contains(a, F.lit(21)), scalar.add(b, F.lit(3)), scalar.hex_dump(a), scalar.words(b)).collect()
    number = sum(1 << k for k in (15, 16, 21, 75, 111))
    assert [*row[0]] == [[16, 75], True, True, False, 5, True, [3, 16, 75], f"{number:032x}", [1 << 16, 1 << 11]]
    assert row[1][0] == [] and row[1][1] is True and row[1][2] is False and row[1][3] is True


def test_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1001.0], 1), ([0.0, 0.0], 0)], "z array<double>, y int").withColumn("p", scalar.softmax(F.col("z")))
    rows = df.select("p", scalar.argmax(F.col("p")).alias("k"), scalar.softmax_cross_entropy(F.col("p"), F.col("y")).alias("l")).collect()
    assert rows[0]["p"][1] == pytest.approx(1 / (1 + math.exp(-1))) and rows[0]["k"] == 1
    assert rows[1]["p"] == [0.5, 0.5] and rows[1]["k"] == 0 and rows[1]["l"] == pytest.approx(math.log(2))


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.99, 1.0, 9.99, 10.0, -5.0, 1e308, float("nan"), None)], "v double")
    got = [r[0] for r in df.select(scalar.uniform_bin("v", 0.0, 10.0, 10)).collect()]
    assert got == [0, 0, 1, 9, 9, 0, 9, -1, -1]
    assert {r[0] for r in df.select(scalar.uniform_bin("v", 3.0, 3.0, 10)).collect()} == {0, -1}
    d = load(spark.createDataFrame([(1, float("nan"), 2.0), (2, 4.0, None)], "id long, a double, b double"), id_col="id")
    assert [x[1:] for x in fit_quantizer(d, {"a": 4}).numeric] == [(4.0, 4.0, 4), (2.0, 2.0, 32)]


def test_auc(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 40, 600), rng.integers(0, 2, 600), strict=True)]
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(want)
    assert auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_streams(spark, tmp_path):
    schema = "id long, at timestamp, v double, k string"
    rows = [(k, f"2024-01-01T00:{k:02d}:00", float(k % 4), "ab"[k % 2]) for k in range(20)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("id", "at", "v", "k"), r, strict=True))) for r in rows))
    still = Dataset(spark.read.schema(schema).json(f"file://{folder}"), "id", ("v",), ("k",))
    model = UODModel(n=4).fit(still)
    stream = still.with_frame(spark.readStream.schema(schema).json(f"file://{folder}"))
    outputs = {
        "scored": (scoring.score_stream(model, stream), "append"),
        "counted": (scoring.count_stream(stream, model.closures.quantizer), "complete"),
        "spans": (scoring.windowed_counts(stream, model.closures.quantizer, "at", "10 minutes"), "complete"),
    }
    for name, (df, mode) in outputs.items():
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, model.predict(still).collect()))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, model.closures.tuples.collect()))
    assert spark.table("spans").agg(F.sum("n")).first()[0] == 20
    query = scoring.maintain(stream, model.closures.quantizer, f"file://{tmp_path}/counts", f"file://{tmp_path}/state")
    query.processAllAvailable()
    (folder / "b.json").write_text((folder / "a.json").read_text())
    query.processAllAvailable()
    query.stop()
    merged = spark.read.parquet(f"file://{tmp_path}/counts/version=1")
    assert merged.agg(F.sum("n")).first()[0] == 40 and merged.count() == model.closures.tuples.count()
