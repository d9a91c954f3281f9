"""Unsupervised and supervised outlier detection over closure sizes."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import outlier_degree, weighted_sum
from ..plans.feature_sets import EXPLORERS, ConfigurableSelector, FeatureSet, Selector, as_frame
from ..sources.dataset import Dataset
from ..sources.loaders import load as load_data
from .closures import Closures, build, from_tuples, long_form, sizes_of
from .explain import Explanation
from .quantize import Quantizer, fit_quantizer
from .training import Gram, GradientDescent, OutlierLoss, gram, signed_sums

log = logging.getLogger(__name__)


class Model(Protocol):
    def fit(self, data: Any, **roles: Any) -> Model: ...
    def predict(self, data: Any, **roles: Any) -> DataFrame: ...


@dataclass
class _Base:
    """What the models share: bins, feature sets and the table of closures. A fit replaces all fitted state."""

    n: int | Mapping[str, int] = 32
    quantizer: str = "uniform"
    explorer: str = "none"
    singletons: bool = True
    doubletons: bool = True
    full: bool = True
    selector: Selector | None = None
    closures: Closures | None = field(default=None, repr=False)
    suggested: list[FeatureSet] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        if self.quantizer != "uniform":
            raise ValueError(f"unknown quantizer {self.quantizer!r}; there is 'uniform'")
        if self.explorer not in EXPLORERS:
            raise ValueError(f"unknown explorer {self.explorer!r}; there is 'none'")
        self.selector = self.selector or ConfigurableSelector(self.singletons, self.doubletons, self.full)

    def _sets(self, data: Dataset) -> list[FeatureSet]:
        sets = [*self.selector(len(data.features)), *self.suggested]
        if len({*sets}) > 2000:
            log.warning("%d feature sets: rows times sets are looked up; doubletons=False has fewer", len(sets))
        return sets

    def _explored(self, train: Callable[[], Sequence[float]]) -> None:
        """Trains, and again with what the explorer suggests, until that is nothing. ``train`` returns the sets' weights."""
        self.suggested, start = [], 0
        while True:
            weights = train()
            known = self.feature_sets
            new = [tuple(sorted({*s})) for s in EXPLORERS[self.explorer](self._fitted().features, start, [*known], weights)]
            if not new:
                return
            if any(not s or not 0 <= s[0] <= s[-1] < self._fitted().features for s in new):
                raise ValueError("the explorer suggests a set of unknown features")
            start = len(known)
            self.suggested += new

    def _fitted(self) -> Closures:
        if self.closures is None:
            raise ValueError("the model isn't fitted")
        return self.closures

    @property
    def feature_sets(self) -> list[FeatureSet]:
        return self._fitted().sets

    @property
    def names(self) -> list[str]:
        return [*self._fitted().quantizer.features]

    def feature_set_frame(self, spark: SparkSession) -> DataFrame:
        return as_frame(spark, self.feature_sets, self.names)

    def set(self, name: str, value: Any) -> None:
        """Changes a parameter; it counts from the next fit on."""
        if name not in self.__dataclass_fields__ or name in ("closures", "suggested"):
            raise ValueError(f"no parameter {name!r}")
        setattr(self, name, value)
        if name in ("singletons", "doubletons", "full"):
            self.selector = ConfigurableSelector(self.singletons, self.doubletons, self.full)

    def estimate_size(self) -> int:
        """Bytes of the counts, at least: eight for each bin and count."""
        c = self._fitted()
        return 8 * (c.features + len(c.counts)) * (c.tuples.count() + sum(c.rows.values()))

    def _meta(self) -> dict:
        c = self._fitted()
        return {"model": type(self).__name__, "quantizer": c.quantizer.to_dict(), "sets": [list(s) for s in c.sets], "counts": c.counts, "params": {k: dict(v) if isinstance(v, Mapping) else v for k, v in ((p, getattr(self, p)) for p in self._params())}}

    def _params(self) -> tuple[str, ...]:
        return ("n", "quantizer", "explorer", "singletons", "doubletons", "full")

    def save(self, path: str) -> None:
        """The counts by tuple as Parquet, all else as one JSON text."""
        c = self._fitted()
        c.tuples.write.mode("overwrite").parquet(f"{path}/tuples")
        c.tuples.sparkSession.createDataFrame([(json.dumps(self._meta()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Any:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        if meta["model"] != cls.__name__:
            raise ValueError(f"the folder holds a {meta['model']}, not a {cls.__name__}")
        model = cls(**meta["params"])
        model.closures = from_tuples(spark.read.parquet(f"{path}/tuples").persist(), Quantizer.from_dict(meta["quantizer"]), [tuple(s) for s in meta["sets"]], meta["counts"])
        model._restore(meta)
        return model

    def _restore(self, meta: dict) -> None:
        pass


@dataclass
class UODModel(_Base):
    """A row's score is the mean of ``exp(-n^2)`` over the feature sets, ``n`` training rows sharing its bins there."""

    def fit(self, data: Any, **roles: Any) -> UODModel:
        data = load_data(data, **roles)
        quantizer = fit_quantizer(data, self.n)

        def train() -> list[float]:
            self.closures = build(data, quantizer, self._sets(data), {"n": F.lit(1)})
            return [1.0] * len(self.feature_sets)

        self._explored(train)
        return self

    def degrees(self, data: Any, **roles: Any) -> DataFrame:
        """The id and ``degrees``, an array in the order of the feature sets."""
        data = load_data(data, **roles)
        return sizes_of(data, self._fitted(), "n").select(data.id_col, F.transform("sizes", outlier_degree).alias("degrees"))

    def degrees_long(self, data: Any, **roles: Any) -> DataFrame:
        data = load_data(data, **roles)
        return long_form(self.degrees(data), "degrees", [data.id_col], "degree")

    def _mean(self) -> Any:
        return F.aggregate("degrees", F.lit(0.0), lambda a, x: a + x) / len(self.feature_sets)

    def predict(self, data: Any, **roles: Any) -> DataFrame:
        data = load_data(data, **roles)
        return self.degrees(data).select(data.id_col, self._mean().alias("score"))

    def predict_explain(self, data: Any, **roles: Any) -> Explanation:
        data = load_data(data, **roles)
        frame = self.degrees(data).select(data.id_col, self._mean().alias("prediction"), F.col("degrees").alias("relevances"))
        return Explanation(frame, data.id_col, self.feature_sets, self.names)


@dataclass
class SODModel(_Base):
    """As the unsupervised model, but closures count inliers (label 0) alone and the sets have learned weights."""

    learning_rate: float = 0.01
    momentum: float = 0.01
    stop_threshold: float = 0.001
    epochs: int = 2000
    show_training: bool = True
    seed: int = 0
    gradient: str = "reference"
    weights: np.ndarray | None = field(default=None, repr=False)
    epochs_run: int = 0

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.gradient not in ("reference", "exact"):
            raise ValueError("gradient is 'reference' or 'exact'")

    def _params(self) -> tuple[str, ...]:
        return (*super()._params(), "learning_rate", "momentum", "stop_threshold", "epochs", "show_training", "seed", "gradient")

    def _meta(self) -> dict:
        return super()._meta() | {"weights": None if self.weights is None else [*map(float, self.weights)]}

    def _restore(self, meta: dict) -> None:
        self.weights = None if meta["weights"] is None else np.array(meta["weights"])

    def fit_closures(self, data: Any, **roles: Any) -> SODModel:
        """Counts only. Rows with a null label are left out."""
        data = load_data(data, **roles)
        if data.label is None:
            raise ValueError("the supervised model needs a label")
        data = data.with_frame(data.df.where(F.col(data.label).isNotNull()))
        inlier = F.col(data.label) == 0
        self.closures = build(data, fit_quantizer(data, self.n), self._sets(data), {"n_inlier": inlier, "n_outlier": ~inlier})
        return self

    def statistics(self) -> OutlierLoss:
        """Gram statistics of the training rows' degrees by class, from the distinct tuples."""
        from .closures import look_up

        c = self._fitted()
        own = c.tuples.withColumnsRenamed({"n_inlier": "w_inlier", "n_outlier": "w_outlier"})
        frame = look_up(own, c, "n_inlier").select(F.transform("sizes", outlier_degree).alias("degrees"), "w_inlier", "w_outlier")
        inliers, outliers = gram(frame, "degrees", ["w_inlier", "w_outlier"])
        if not outliers.k:
            raise ValueError("there is no outlier to learn from")
        if not inliers.k:
            inliers = Gram(np.zeros_like(outliers.G), np.zeros_like(outliers.s), 0.0)
        return OutlierLoss(inliers, outliers, (inliers.k + outliers.k) / outliers.k)

    def fit(self, data: Any, **roles: Any) -> SODModel:
        data = load_data(data, **roles)

        def train() -> list[float]:
            self.fit_closures(data)
            loss = self.statistics()
            descent = GradientDescent(loss.loss, lambda w: loss.gradient(w, self.gradient), len(self.feature_sets), self.learning_rate, self.momentum, self.stop_threshold, self.seed)
            self.epochs_run = descent.train(self.epochs, self.show_training)
            self.set_weights(descent.weights)
            return [*map(float, descent.weights)]

        self._explored(train)
        return self

    def set_weights(self, weights: Any) -> SODModel:
        w = np.asarray(weights, float)
        if w.shape != (len(self.feature_sets),):
            raise ValueError(f"{len(self.feature_sets)} weights are needed")
        self.weights = w
        if abs(sum(signed_sums(w))) < 1e-6:
            log.warning("the weights add up to nearly 0: scores are very large")
        return self

    def get_weights(self) -> np.ndarray:
        if self.weights is None:
            raise ValueError("the model has no weights")
        return self.weights

    def degrees(self, data: Any, **roles: Any) -> DataFrame:
        data = load_data(data, **roles)
        return sizes_of(data, self._fitted(), "n_inlier").select(data.id_col, F.transform("sizes", outlier_degree).alias("degrees"))

    def _score(self) -> Any:
        plus, minus = signed_sums(self.get_weights())
        return (weighted_sum(F.col("degrees"), self.get_weights()) - F.lit(minus)) / F.lit(plus + minus)

    def predict(self, data: Any, **roles: Any) -> DataFrame:
        """``score``, which isn't held to 0 to 1."""
        data = load_data(data, **roles)
        return self.degrees(data).select(data.id_col, self._score().alias("score"))

    def predict_explain(self, data: Any, **roles: Any) -> Explanation:
        data = load_data(data, **roles)
        w = F.array(*[F.lit(float(x)) for x in self.get_weights()])
        frame = self.degrees(data).select(data.id_col, self._score().alias("prediction"), F.zip_with("degrees", w, lambda d, x: d * x).alias("relevances"))
        return Explanation(frame, data.id_col, self.feature_sets, self.names)
