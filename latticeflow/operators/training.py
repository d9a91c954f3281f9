"""Training from sufficient statistics: one distributed pass, then epochs on the driver in as many dimensions as sets."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Gram:
    """Of one class: ``sum(d d')``, ``sum(d)`` and the number of rows."""

    G: np.ndarray
    s: np.ndarray
    k: float


#: What a task returns that sums its rows: ``sums`` are the bytes of doubles.
SUMS = "k int, sums binary"
#: Tasks that sum the tasks.
MERGERS = 8


def merged(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of ``parts`` (``SUMS``) by ``k``. The driver gets those of ``MERGERS`` tasks, however many tasks ``parts`` has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "sums"])

    total: dict[int, np.ndarray] = {}
    for r in parts.repartition(MERGERS).mapInArrow(merge, SUMS).collect():
        total[r["k"]] = total.get(r["k"], 0) + np.frombuffer(bytes(r["sums"]))
    return total


def gram(frame: DataFrame, degrees: str, weights: Sequence[str]) -> list[Gram]:
    """The statistics of the rows' degree vectors, under each weight column.

    A task sums its rows, a few tasks sum the tasks, so that what comes to the driver doesn't grow with the rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(degrees)
            d = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = []
            for w in weights:
                n = batch.column(w).to_numpy(zero_copy_only=False).astype(float)
                own.append(np.concatenate([(d.T @ (d * n[:, None])).ravel(), n @ d, [n.sum()]]))
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        for k, x in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "sums"])

    total = merged(frame.select(degrees, *weights).mapInArrow(sums, SUMS))
    out = []
    for k in range(len(weights)):
        if k not in total:
            out.append(Gram(np.zeros((0, 0)), np.zeros(0), 0.0))
            continue
        x = total[k]
        size = round((-1 + np.sqrt(1 + 4 * (len(x) - 1))) / 2)
        out.append(Gram(x[: size * size].reshape(size, size), x[size * size : -1], float(x[-1])))
    return out


def signed_sums(w: np.ndarray) -> tuple[float, float]:
    """The sums of the positive and of the negative weights."""
    return float(w[w > 0].sum()), float(w[w < 0].sum())


@dataclass(frozen=True)
class OutlierLoss:
    """Squared error of ``(w d - W-) / (W+ + W-)`` against 0 for inliers (divided by ``balance``) and 1 for outliers."""

    inliers: Gram
    outliers: Gram
    balance: float

    def _terms(self) -> Iterator[tuple[Gram, float, float]]:
        yield self.inliers, 0.0, 1 / self.balance
        yield self.outliers, 1.0, 1.0

    def loss(self, w: np.ndarray) -> float:
        plus, minus = signed_sums(w)
        total, out = plus + minus, 0.0
        for g, target, c in self._terms():
            if g.k:
                a = -minus / total - target
                out += c * (w @ g.G @ w / total**2 + 2 * a * (w @ g.s) / total + g.k * a * a)
        return float(out)

    def gradient(self, w: np.ndarray, kind: str = "reference") -> np.ndarray:
        """``reference``: the known models' formula, which leaves the slope of ``W-`` out; ``exact``: the derivative."""
        plus, minus = signed_sums(w)
        total, out = plus + minus, np.zeros(len(w))
        for g, target, c in self._terms():
            if not g.k:
                continue
            a = -minus / total - target
            r = w @ g.s / total + g.k * a  # sum of residuals
            rd = g.G @ w / total + a * g.s  # residuals by degrees
            rwd = w @ g.G @ w / total + a * (w @ g.s)  # residuals by w d
            if kind == "reference":
                out += 2 * c * ((rd - r) / total - rwd / total**2)
            else:
                out += 2 * c * ((rd - (w < 0) * r) / total - (rwd - minus * r) / total**2)
        return out


@dataclass
class GradientDescent:
    """Heavy ball: ``step = momentum * step - rate * gradient``. Ends if the loss falls by less than ``threshold``.

    A loss that grows never ends it. ``weights`` start uniform in -1 to 1 from ``seed``.
    """

    loss: Callable[[np.ndarray], float]
    gradient: Callable[[np.ndarray], np.ndarray]
    size: int
    rate: float = 0.01
    momentum: float = 0.01
    threshold: float = 0.001
    seed: int = 0

    def __post_init__(self) -> None:
        self.reinitialize()

    def reinitialize(self) -> None:
        self.weights = np.random.default_rng(self.seed).uniform(-1, 1, self.size)
        self.step = np.zeros(self.size)

    def iterate(self) -> None:
        self.step = self.momentum * self.step - self.rate * self.gradient(self.weights)
        self.weights = self.weights + self.step

    def train(self, epochs: int, show: bool = False) -> int:
        """Runs up to ``epochs`` and returns how many it ran."""
        before = self.loss(self.weights)
        for epoch in range(1, epochs + 1):
            self.iterate()
            now = self.loss(self.weights)
            if show and (epoch % 100 == 0 or epoch == 1):
                log.info("epoch %d of %d: loss %.6g", epoch, epochs, now)
            if 0 <= before - now < self.threshold:
                log.info("ended after epoch %d: loss %.6g", epoch, now)
                return epoch
            before = now
        return epochs
