"""Rounds of suggested feature sets."""

import pytest

from latticeflow.operators.outlier import SODModel, UODModel
from latticeflow.plans import feature_sets

from .test_models import TX, TXC, XC, X, Y


@pytest.mark.parametrize("model", [UODModel, SODModel])
def test_rounds(spark, monkeypatch, model):
    """An explorer joins the two heaviest of the newest sets, as long as that is a new set."""
    rounds = []

    def joined(features, start, sets, weights):
        rounds.append((features, start, len(sets), len(weights)))
        heavy = sorted(range(start, len(sets)), key=lambda k: -abs(weights[k]))[:2]
        new = tuple(sorted({x for k in heavy for x in sets[k]}))
        return [new] if new not in sets else []

    monkeypatch.setitem(feature_sets.EXPLORERS, "joined", joined)
    found = model(n=4, doubletons=False, full=False, explorer="joined").fit(X, Xc=XC, y=Y)
    assert rounds == [(4, 0, 4, 4), (4, 4, 5, 5)]
    assert len(found.feature_sets) == 5 and len(found.feature_sets[4]) == 2
    plain = model(n=4, selector=lambda _: found.feature_sets).fit(X, Xc=XC, y=Y)
    score = lambda m: [r["score"] for r in m.predict(TX, Xc=TXC).orderBy("row_id").collect()]
    assert score(found) == pytest.approx(score(plain))
    again = model(n=4, doubletons=False, full=False).fit(X, Xc=XC, y=Y)
    assert len(again.feature_sets) == 4


def test_unknown_features_are_refused(spark, monkeypatch):
    monkeypatch.setitem(feature_sets.EXPLORERS, "far", lambda features, start, sets, weights: [(features,)])
    with pytest.raises(ValueError):
        UODModel(explorer="far").fit(X, Xc=XC)
