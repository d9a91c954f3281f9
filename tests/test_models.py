"""Models against brute force and the goldens of the fixtures."""

import math

import numpy as np
import pandas as pd
import pytest

from latticeflow.operators import closures as closure_ops
from latticeflow.operators.classifier import CNClassifier
from latticeflow.operators.outlier import SODModel, UODModel
from latticeflow.operators.quantize import fit_quantizer
from latticeflow.operators.training import Gram, GradientDescent, OutlierLoss
from latticeflow.plans.feature_sets import ConfigurableSelector
from latticeflow.sources.loaders import load

#: The known fixtures' matrices, training and test rows.
X = np.array([[5.3, 3.2, 2.4], [3.1, 8.7, 4.2], [3.2, 8.8, 5.2], [1.2, 5.3, 8.8], [3.2, 1.2, 1.0], [9.0, 8.9, 2.0], [3.6, 1.7, 1.4], [5.6, 6.9, 2.3]])
XC = np.array([[0], [1], [1], [0], [0], [1], [1], [0]])
Y = np.array([0, 1, 1, 0, 0, 1, 0, 0])
TX, TXC = np.array([[2.2, 8.75, 6.3], [5.4, 2.2, 1.7]]), np.array([[1], [0]])


def scores(frame, column="score"):
    return [r[column] for r in frame.orderBy(frame.columns[0]).collect()]


@pytest.fixture(params=["wide", "long"])
def strategy(request, monkeypatch):
    monkeypatch.setattr(closure_ops, "WIDE", 80 if request.param == "wide" else 1)


def test_uod_goldens(spark, strategy):
    model = UODModel(n=4).fit(X, Xc=XC, y=Y)
    assert scores(model.predict(TX, Xc=TXC)) == pytest.approx([0.350723616081, 0.223598287088], abs=1e-11)
    assert scores(model.predict(TX, Xc=1 - TXC)) == pytest.approx([0.499086993265, 0.314496158924], abs=1e-11)
    own = [0.172224331, 0.235792605, 0.202360239, 0.239100283, 0.107013437, 0.20234902, 0.076888749, 0.108667276]
    assert scores(model.predict(X, Xc=XC)) == pytest.approx(own, abs=1e-9)
    data = load(X, Xc=XC)
    bins = data.df.orderBy("row_id").select(*model.closures.quantizer.bins()).collect()
    assert ["".join(str(v).lstrip("v") for v in r) for r in bins] == "2100 0311 1321 0230 1000 3301 1001 2200".split()


def test_predictions_equal_explanations(spark):
    for model in (UODModel(n=4), SODModel(n=4, epochs=100)):
        model.fit(X, Xc=XC, y=Y)
        explained = model.predict_explain(TX, Xc=TXC)
        assert scores(model.predict(TX, Xc=TXC)) == pytest.approx(scores(explained.predictions(), "prediction"), abs=1e-9)
        entries = explained[0]
        assert len(entries) == 11 and [v for _, v in entries] == sorted((v for _, v in entries), reverse=True)
        assert explained.entries(3).count() == 6
        assert [*explained.iterate(0)] == entries
        assert explained.to_string(1).count(":") == 4
        with pytest.raises(KeyError):
            explained[99]


def brute(train, probe, sets, inlier=None):
    keep = range(len(train)) if inlier is None else np.flatnonzero(inlier)
    return np.array([[sum(all(train[o][i] == x[i] for i in s) for o in keep) for s in sets] for x in probe])


@pytest.mark.parametrize("seed", range(2))
def test_sizes_equal_brute_force(spark, strategy, seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"a": rng.integers(0, 4, 40) * 1.0, "b": rng.normal(size=40), "c": rng.choice(["x", "y", None], 40)})
    frame.loc[3, "a"] = np.nan
    data = load(frame, spark=spark)
    sets = ConfigurableSelector()(3)
    quantizer = fit_quantizer(data, {"b": 3}, 5)
    closures = closure_ops.build(data, quantizer, sets, {"n": closure_ops.F.lit(1)})
    rows = data.df.orderBy("row_id").select(*quantizer.bins()).collect()
    got = [r["sizes"] for r in closure_ops.sizes_of(data, closures, "n").orderBy("row_id").collect()]
    want = brute(rows, rows, sets)
    assert (np.array(got) == want).all()
    singles = {s[0]: k for k, s in enumerate(sets) if len(s) == 1}
    for k, s in enumerate(sets):
        assert all((want[:, k] <= want[:, singles[i]]).all() for i in s)
    totals = closures.tuples.agg(closure_ops.F.sum("n")).first()[0]
    assert totals == 40


def test_edge_cases(spark, strategy):
    one = load(pd.DataFrame({"a": [1.0]}), spark=spark)
    model = UODModel().fit(one)
    assert len(model.feature_sets) == 2 and scores(model.predict(one)) == pytest.approx([math.exp(-1)])
    two = load(pd.DataFrame({"a": [1.0, 1.0, 1.0], "b": [0.0, 5.0, 9.0]}), spark=spark)
    model = UODModel(n=3).fit(two)
    assert model.feature_sets == [(0,), (0, 1), (1,), (0, 1)]
    assert scores(model.predict(two)) == pytest.approx([(math.exp(-9) + 3 * math.exp(-1)) / 4] * 3)
    far = load(pd.DataFrame({"a": [1.0, 1e308, np.nan], "b": [-1e300, 5.0, 0.0]}), spark=spark)
    assert len(scores(model.predict(far))) == 3
    classes = load(pd.DataFrame({"k": ["x", "y", None]}), spark=spark)
    model = UODModel().fit(classes)
    assert scores(model.predict(load(pd.DataFrame({"k": ["x", "z", None]}), spark=spark))) == pytest.approx([math.exp(-1), 1.0, math.exp(-1)])
    empty = two.with_frame(two.df.limit(0))
    assert UODModel().fit(empty).predict(two).count() == 3
    assert model.predict(classes.with_frame(classes.df.limit(0))).count() == 0


def test_refused(spark):
    with pytest.raises(ValueError):
        UODModel(quantizer="other")
    with pytest.raises(ValueError):
        UODModel(explorer="other")
    with pytest.raises(ValueError):
        UODModel(singletons=False, doubletons=False, full=False).fit(X)
    with pytest.raises(ValueError):
        UODModel().predict(X)
    with pytest.raises(ValueError):
        UODModel().fit(X).predict(X[:, :2])
    with pytest.raises(ValueError):
        SODModel().fit(X)
    with pytest.raises(ValueError):
        SODModel().fit(X, y=Y * 0)
    with pytest.raises(ValueError):
        SODModel(gradient="other")


def test_save_and_load(spark, tmp_path):
    for model, predict in ((UODModel(n=4), "score"), (SODModel(n=4, epochs=50), "score"), (CNClassifier(n=4, epochs=10), "label")):
        path = f"file://{tmp_path}/{type(model).__name__}"
        model.fit(X, Xc=XC, y=Y).save(path)
        again = type(model).load(spark, path)
        assert scores(again.predict(TX, Xc=TXC), predict) == scores(model.predict(TX, Xc=TXC), predict)
        assert again.feature_sets == model.feature_sets and again.estimate_size() == model.estimate_size() > 0
    with pytest.raises(ValueError):
        UODModel.load(spark, path)


def naive(degrees, y, w, balance):
    plus, minus = w[w > 0].sum(), w[w < 0].sum()
    s = (degrees @ w - minus) / (plus + minus)
    return (np.where(y == 0, s**2 / balance, (1 - s) ** 2)).sum(), s


def test_loss_and_gradients(spark):
    model = SODModel(n=4).fit_closures(X, Xc=XC, y=Y)
    loss = model.statistics()
    degrees = np.array([r["degrees"] for r in model.degrees(X, Xc=XC).orderBy("row_id").collect()])
    w = np.random.default_rng(1).uniform(-1, 1, 11)
    want, s = naive(degrees, Y, w, loss.balance)
    assert loss.balance == 8 / 3 and loss.loss(w) == pytest.approx(want)
    total = w.sum()
    slope = (degrees - 1) * total - (degrees @ w)[:, None]
    plain = (np.where(Y == 0, 2 * s / loss.balance, -2 * (1 - s))[:, None] * slope / total**2).sum(0)
    assert loss.gradient(w) == pytest.approx(plain)
    steps = np.eye(11) * 1e-6
    finite = [(naive(degrees, Y, w + e, loss.balance)[0] - naive(degrees, Y, w - e, loss.balance)[0]) / 2e-6 for e in steps]
    assert loss.gradient(w, "exact") == pytest.approx(finite, rel=1e-4, abs=1e-5)


def test_descent():
    one = OutlierLoss(Gram(np.eye(2), np.zeros(2), 2.0), Gram(np.eye(2), np.ones(2), 1.0), 3.0)
    a, b = (GradientDescent(one.loss, one.gradient, 2, seed=5) for _ in range(2))
    assert a.train(20) == b.train(20) and (a.weights == b.weights).all()
    assert GradientDescent(lambda w: 1.0, lambda w: w * 0, 2).train(50) == 1
    rising = iter(range(100))
    assert GradientDescent(lambda w: float(next(rising)), lambda w: w * 0, 2).train(7) == 7
    a.reinitialize()
    assert (a.step == 0).all()


def test_training_lowers_the_loss(spark):
    model = SODModel(n=4, epochs=400, stop_threshold=1e-9, gradient="exact", seed=3).fit(X, Xc=XC, y=Y)
    start = GradientDescent(lambda w: 0.0, lambda w: w, 11, seed=3).weights
    loss = model.statistics()
    assert loss.loss(model.get_weights()) < loss.loss(start)
    model.set("n", 8)
    assert model.n == 8


def test_classifier(spark, strategy, monkeypatch):
    model = CNClassifier(n=4, epochs=60).fit(X, Xc=XC, y=Y)
    assert scores(model.predict(X, Xc=XC), "label") == Y.tolist()
    p = np.array(scores(model.predict_proba(TX, Xc=TXC), "probabilities"))
    assert p.sum(1) == pytest.approx([1, 1])
    rows = load(X, Xc=XC).df.orderBy("row_id").select(*model.closures.quantizer.bins()).collect()
    h = np.stack([brute(rows, rows, model.feature_sets, Y == c) for c in (0, 1)], 2)
    want = (h / np.maximum(h.max(2, keepdims=True), 1)).reshape(8, -1)
    assert np.array(scores(model.scores(X, Xc=XC), "scores")) == pytest.approx(want)
    unseen = model.scores(TX, Xc=TXC + 7).first()["scores"]
    assert 0.0 in unseen
    from latticeflow.operators import classifier

    monkeypatch.setattr(classifier, "LOCAL_ROWS", 0)
    assert CNClassifier(n=4, epochs=60).fit(X, Xc=XC, y=Y).weights == pytest.approx(model.weights)
