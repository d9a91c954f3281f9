"""Classification by the class shares of closures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax, softmax
from ..sources.loaders import load as load_data
from .closures import build, look_up
from .outlier import _Base
from .quantize import fit_quantizer
from .training import SUMS, GradientDescent, merged

#: Distinct training rows (scores and label) up to this number, with so many scores in all, train on the driver, others on the cluster.
LOCAL_ROWS, LOCAL_SCORES = 50_000, 2_000_000
#: Tasks of an epoch for each core of the cluster.
TASKS_A_CORE = 2


@dataclass
class CNClassifier(_Base):
    """Scores are, for each feature set and class, the class's count in the closure over the largest class's count.

    An empty closure scores 0. Probabilities are the softmax of ``weights`` (classes by sets times classes) and scores.
    """

    learning_rate: float = 0.5
    momentum: float = 0.5
    stop_threshold: float = 1e-6
    epochs: int = 200
    show_training: bool = False
    seed: int = 0
    max_classes: int = 1000
    classes: list[int] = field(default_factory=list)
    weights: np.ndarray | None = field(default=None, repr=False)
    epochs_run: int = 0

    def _params(self) -> tuple[str, ...]:
        return (*super()._params(), "learning_rate", "momentum", "stop_threshold", "epochs", "show_training", "seed", "max_classes")

    def _meta(self) -> dict:
        return super()._meta() | {"classes": self.classes, "weights": None if self.weights is None else self.weights.tolist()}

    def _restore(self, meta: dict) -> None:
        self.classes = meta["classes"]
        self.weights = None if meta["weights"] is None else np.array(meta["weights"])

    def fit_closures(self, data: Any, **roles: Any) -> CNClassifier:
        data = load_data(data, **roles)
        if data.label is None:
            raise ValueError("the classifier needs a label")
        data = data.with_frame(data.df.where(F.col(data.label).isNotNull()))
        found = data.df.select(F.col(data.label).cast("int").alias("label")).distinct().limit(self.max_classes + 1).collect()
        if not 1 <= len(found) <= self.max_classes:
            raise ValueError(f"1 to {self.max_classes} classes are needed")
        self.classes = sorted(r["label"] for r in found)
        label = F.col(data.label).cast("int")
        self.closures = build(data, fit_quantizer(data, self.n), self._sets(data), {f"n{c}": label == x for c, x in enumerate(self.classes)})
        return self

    def _scored(self, frame: DataFrame) -> DataFrame:
        """``frame`` (with bins) and ``scores``, by set and then class."""
        out = look_up(frame, self._fitted(), [f"n{c}" for c in range(len(self.classes))])
        sets = F.transform("sizes", lambda h: h.cast("array<double>"))
        share = F.transform(sets, lambda h: F.transform(h, lambda v: F.when(F.array_max(h) > 0, v / F.greatest(F.array_max(h), F.lit(1.0))).otherwise(F.lit(0.0))))
        return out.select(*frame.columns, F.flatten(share).alias("scores"))

    def scores(self, data: Any, **roles: Any) -> DataFrame:
        data = load_data(data, **roles)
        closures = self._fitted()
        closures.quantizer.check(data)
        return self._scored(data.df.select(data.id_col, *closures.quantizer.bins())).select(data.id_col, "scores")

    def set_weights(self, weights: Any) -> CNClassifier:
        w = np.asarray(weights, float)
        shape = (len(self.classes), len(self.feature_sets) * len(self.classes))
        if w.shape != shape:
            raise ValueError(f"weights of shape {shape} are needed")
        self.weights = w
        return self

    def predict_proba(self, data: Any, **roles: Any) -> DataFrame:
        """``probabilities``, in the order of ``classes``."""
        data = load_data(data, **roles)
        return self.scores(data).withColumn("logits", self._logits()).select(data.id_col, softmax(F.col("logits")).alias("probabilities"))

    def _logits(self) -> Column:
        if self.weights is None:
            raise ValueError("the model has no weights")
        return F.array(*[F.aggregate(F.zip_with("scores", F.array(*[F.lit(float(x)) for x in row]), lambda s, x: s * x), F.lit(0.0), lambda a, x: a + x) for row in self.weights])

    def predict(self, data: Any, **roles: Any) -> DataFrame:
        """``label``: the class with the largest probability, the first of equals."""
        data = load_data(data, **roles)
        classes = F.array(*[F.lit(int(c)) for c in self.classes])
        return self.predict_proba(data).select(data.id_col, F.element_at(classes, argmax(F.col("probabilities")) + 1).alias("label"))

    def _training(self) -> DataFrame:
        """The distinct scores with their class and number of rows."""
        c = self._fitted()
        weights = [f"w{k}" for k in range(len(self.classes))]
        own = c.tuples.withColumnsRenamed({f"n{k}": w for k, w in enumerate(weights)})
        counts = F.array(*[F.col(w) for w in weights])
        return self._scored(own).select("scores", F.posexplode(counts).alias("y", "n")).where("n > 0").groupBy("scores", "y").agg(F.sum("n").alias("n"))

    def _objective(self) -> tuple[DataFrame, int, Callable[[np.ndarray], tuple[float, np.ndarray]]]:
        """The training rows (persisted), their number, and the sums of loss and gradient at a matrix of weights."""
        rows = self._training().persist()
        n = rows.agg(F.sum("n")).first()[0]
        distinct = rows.count()
        if distinct > LOCAL_ROWS or distinct * len(self.feature_sets) * len(self.classes) > LOCAL_SCORES:
            return rows, n, lambda w: _on_cluster(rows, w)
        held = rows.toArrow().combine_chunks()
        scores = held["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(distinct, -1)
        parts = (scores, held["y"].to_numpy(), held["n"].to_numpy().astype(float))
        return rows, n, lambda w: _cross_entropy(w, *parts)

    def loss_and_gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean cross-entropy over the training rows, and its derivative by class and place."""
        rows, n, evaluate = self._objective()
        loss, gradient = evaluate(np.asarray(weights, float).reshape(len(self.classes), -1))
        rows.unpersist()
        return loss / n, gradient / n

    def fit(self, data: Any, **roles: Any) -> CNClassifier:
        """Mean softmax cross-entropy by gradient descent."""
        self.fit_closures(data, **roles)
        size = len(self.classes)
        rows, n, evaluate = self._objective()
        last: dict[str, Any] = {}

        def both(w: np.ndarray) -> tuple[float, np.ndarray]:
            key = w.tobytes()
            if last.get("key") != key:
                last.update(key=key, value=evaluate(w.reshape(size, -1)))
            return last["value"]

        descent = GradientDescent(lambda w: both(w)[0] / n, lambda w: both(w)[1].ravel() / n, size * size * len(self.feature_sets), self.learning_rate, self.momentum, self.stop_threshold, self.seed)
        descent.weights = descent.weights * 0.01
        self.epochs_run = descent.train(self.epochs, self.show_training)
        rows.unpersist()
        return self.set_weights(descent.weights.reshape(size, -1))


def _cross_entropy(w: np.ndarray, scores: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    z = scores @ w.T
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(y))
    loss = -(n * np.log(np.maximum(p[at, y], 1e-300))).sum()
    p[at, y] -= 1
    return float(loss), (p * n[:, None]).T @ scores


def _on_cluster(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The sums of one epoch.

    A task goes through several partitions and sums them, a few tasks sum the tasks: neither the tasks of an epoch nor what
    comes to the driver grow with the rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros_like(w)
        for batch in batches:
            if batch.num_rows:
                scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = _cross_entropy(w, scores, batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(float))
                loss, gradient = loss + own[0], gradient + own[1]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(gradient, loss).tobytes()], pa.binary())], names=["k", "sums"])

    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    total = merged(rows.coalesce(tasks).mapInArrow(sums, SUMS))[0]
    return float(total[-1]), total[:-1].reshape(w.shape)
