"""Closure sizes: how many training rows share a row's bins on each feature set.

Training rows are first counted by their whole tuple of bins; all smaller sets are summed from those counts in one
grouping-sets aggregation. What a lookup does depends on the size of a set's table, which was counted at fitting:
small ones become constant arrays with a place for each combination of bins, so that a row finds its count in
generated code; larger ones are broadcast; a few of the largest (``ALONE``) and the full set are joined on their bins. If
more are that large, or with very many sets (``WIDE``), the rows' distinct tuples are exploded over the sets, one join
finds all their counts, and another one brings these to the rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.feature_sets import FeatureSet
from ..sources.dataset import Dataset
from .quantize import Quantizer

#: A set's closures are broadcast up to so many rows, and all sets' together up to BROADCAST_TOTAL.
BROADCAST_ROWS, BROADCAST_TOTAL = 100_000, 1_000_000
#: A set is a constant array up to so many combinations of bins, as long as all such arrays together have DENSE_TOTAL.
DENSE, DENSE_TOTAL = 20_000, 200_000
#: A category is found in a constant list up to so many values, else by a broadcast join.
LISTED = 64
#: Up to so many distinct sets, each has its bins in columns.
WIDE = 80
#: Sets that are too large for a broadcast are joined one by one up to so many; more are looked up together.
ALONE = 2


def bin_names(features: int) -> list[str]:
    return [f"b{i}" for i in range(features)]


@dataclass
class Closures:
    """Counts of training rows by tuple (``tuples``) and by set and key (``table``), for all sets but the full one."""

    quantizer: Quantizer
    sets: list[FeatureSet]
    counts: list[str]
    tuples: DataFrame
    table: DataFrame | None
    rows: dict[int, int] = field(default_factory=dict)
    #: By small set: its features' places and strides, and the counts at each place.
    dense: dict[int, tuple[list[int], dict[str, np.ndarray]]] = field(default_factory=dict)
    #: By categorical feature of a small set, its values in order.
    values: dict[int, list[str]] = field(default_factory=dict)

    @property
    def features(self) -> int:
        return len(self.quantizer.features)

    @property
    def distinct(self) -> list[FeatureSet]:
        """The sets without repeats, the full one left out."""
        return [s for s in dict.fromkeys(self.sets) if len(s) < self.features]

    @property
    def wide(self) -> bool:
        return is_wide(self.sets, self.features)

    def unpersist(self) -> None:
        self.tuples.unpersist()
        if self.table is not None:
            self.table.unpersist()


def is_wide(sets: Sequence[FeatureSet], features: int) -> bool:
    return len({*sets}) <= WIDE and features <= 64


def _key(s: FeatureSet) -> Column:
    return F.array(*[F.col(f"b{i}").cast("string") for i in s])


def _exploded(frame: DataFrame, sets: Sequence[FeatureSet], keep: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("set_id"), _key(s).alias("key")) for k, s in enumerate(sets)]
    return frame.select(*keep, F.inline(F.array(*pairs)))


def tuple_counts(data: Dataset, quantizer: Quantizer, counts: Mapping[str, Column]) -> DataFrame:
    """The rows' distinct tuples of bins with sums of the ``counts`` (expressions that are 0 or 1 in a row)."""
    names = bin_names(len(quantizer.features))
    binned = data.df.select(*quantizer.bins(), *[c.cast("long").alias(f"c_{k}") for k, c in counts.items()])
    return binned.groupBy(*names).agg(*[F.sum(f"c_{k}").alias(k) for k in counts])


def closure_table(tuples: DataFrame, sets: Sequence[FeatureSet], features: int, counts: Sequence[str], wide: bool) -> DataFrame | None:
    """Counts by ``set_id`` and bins (wide; null where a bin isn't in the set) or ``key`` (long)."""
    if not sets:
        return None
    sums = [F.sum(c).alias(c) for c in counts]
    if not wide:
        return _exploded(tuples, sets, counts).groupBy("set_id", "key").agg(*sums)
    names = bin_names(features)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x  # noqa: E731  as Spark's long
    ids = {signed(sum(1 << (features - 1 - i) for i in range(features) if i not in s)): k for k, s in enumerate(sets)}
    grouped = tuples.groupingSets([[F.col(names[i]) for i in s] for s in sets], *names).agg(*sums, F.grouping_id().alias("gid"))
    lookup = F.create_map(*[x for gid, k in ids.items() for x in (F.lit(gid).cast("long"), F.lit(k))])
    return grouped.select(lookup[F.col("gid").cast("long")].alias("set_id"), *names, *counts)


def build(data: Dataset, quantizer: Quantizer, sets: Sequence[FeatureSet], counts: Mapping[str, Column], *, keep: bool = True) -> Closures:
    """Counts all sets. ``keep``: the two tables are cached, as every prediction reads them."""
    tuples = tuple_counts(data, quantizer, counts)
    tuples = tuples.persist() if keep else tuples
    return from_tuples(tuples, quantizer, sets, [*counts], keep=keep)


def from_tuples(tuples: DataFrame, quantizer: Quantizer, sets: Sequence[FeatureSet], counts: list[str], *, keep: bool = True) -> Closures:
    out = Closures(quantizer, [*sets], counts, tuples, None)
    out.table = closure_table(tuples, out.distinct, out.features, counts, out.wide)
    if out.table is not None:
        out.table = out.table.persist() if keep else out.table
        out.rows = {r["set_id"]: r["n"] for r in out.table.groupBy("set_id").agg(F.count("*").alias("n")).collect()}  # a row for each set
        if out.wide:
            _make_dense(out)
    return out


def _make_dense(out: Closures) -> None:
    """Collects the tables of small sets: ``DENSE_TOTAL`` rows at most."""
    numeric = [x[3] + 1 for x in out.quantizer.numeric]
    chosen, total = [], 0
    for k in sorted(out.rows, key=out.rows.get):
        if out.rows[k] <= DENSE and total + out.rows[k] <= DENSE_TOTAL:
            chosen.append(k)
            total += out.rows[k]
    if not chosen:
        return
    held = out.table.where(F.col("set_id").isin(chosen)).toArrow().combine_chunks()
    set_id = held["set_id"].to_numpy()
    for i in range(len(numeric), out.features):
        out.values[i] = sorted(v for v in held[f"b{i}"].unique().to_pylist() if v is not None)
    place = {i: {v: k for k, v in enumerate(own)} for i, own in out.values.items()}
    size = numeric + [len(out.values[i]) for i in range(len(numeric), out.features)]
    total = 0
    for k in chosen:
        s = out.distinct[k]
        cells = int(np.prod([size[i] for i in s], dtype=float))
        if not 0 < cells <= DENSE or total + cells > DENSE_TOTAL:
            continue
        total += cells
        strides = [int(np.prod([size[j] for j in s[n + 1 :]], dtype=np.int64)) for n in range(len(s))]
        own = held.filter(set_id == k)
        at = np.zeros(own.num_rows, np.int64)
        for i, stride in zip(s, strides, strict=True):
            bins = own[f"b{i}"]
            at += stride * (np.array([place[i][v] for v in bins.to_pylist()], np.int64) if i in place else bins.to_numpy().astype(np.int64) + 1)
        counts = {}
        for c in out.counts:
            counts[c] = np.zeros(cells, np.int64)
            counts[c][at] = own[c].to_numpy()
        out.dense[k] = (strides, counts)


def _with_places(frame: DataFrame, closures: Closures) -> tuple[DataFrame, dict[int, Column]]:
    """``frame`` with what says each feature's place in constant arrays: null for an unknown category."""
    needed = sorted({i for k in closures.dense for i in closures.distinct[k]})
    places: dict[int, Column] = {}
    for i in needed:
        values = closures.values.get(i)
        if values is None:
            places[i] = F.col(f"b{i}") + 1
        elif len(values) <= LISTED:
            frame = frame.withColumn(f"__place{i}", F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(f"b{i}")), F.lit(0).cast("long")) - 1)
            places[i] = F.col(f"__place{i}")
        else:
            own = frame.sparkSession.createDataFrame([*enumerate(values)], f"__place{i} long, __value{i} string")
            frame = frame.join(F.broadcast(own), F.col(f"b{i}") == F.col(f"__value{i}"), "left").drop(f"__value{i}")  # DENSE values at most
            places[i] = F.col(f"__place{i}")
    return frame, places


def look_up(frame: DataFrame, closures: Closures, count: str | Sequence[str]) -> DataFrame:
    """``frame`` (with the bins ``b0``, ...) and ``sizes``: the count for each set in order, 0 where nothing matches.

    For several counts, ``sizes`` has an array of them for each set.
    """
    value = F.col(count) if isinstance(count, str) else F.array(*count)
    nothing = F.lit(0).cast("long") if isinstance(count, str) else F.array(*[F.lit(0).cast("long") for _ in count])
    names = bin_names(closures.features)
    sets, found = closures.distinct, {}
    out = frame
    if closures.wide and closures.table is not None:
        total, large = 0, []
        out, places = _with_places(out, closures)
        for k, (strides, counts) in closures.dense.items():
            at = sum((places[i] * F.lit(stride) for i, stride in zip(sets[k], strides, strict=True)), F.lit(0).cast("long"))
            constant = counts[count].tolist() if isinstance(count, str) else np.stack([counts[c] for c in count], 1).tolist()
            kind = "array<bigint>" if isinstance(count, str) else "array<array<bigint>>"
            found[sets[k]] = F.get(F.from_json(F.lit(json.dumps(constant)), kind), at.cast("int"))  # folded to a literal
        for k, s in sorted(enumerate(sets), key=lambda x: closures.rows.get(x[0], 0)):
            if k in closures.dense:
                continue
            rows = closures.rows.get(k, 0)
            total += rows
            small = rows <= BROADCAST_ROWS and total <= BROADCAST_TOTAL
            if not small:
                large.append(k)
            if not small and len(large) > ALONE:
                continue
            own = closures.table.where(F.col("set_id") == k).select(*[F.col(names[i]).alias(f"k{k}_{i}") for i in s], value.alias(f"n{k}"))
            out = _on_bins(out, F.broadcast(own) if small else own, [names[i] for i in s], [f"k{k}_{i}" for i in s], spread=not small)
            found[s] = F.col(f"n{k}")
        if len(large) > ALONE:
            own = {k: sets[k] for k in large[ALONE:]}
            keys = F.coalesce(*[F.when(F.col("set_id") == k, _key(s)) for k, s in own.items()])
            out = _together(out, names, own, closures.table.where(F.col("set_id").isin([*own])).select("set_id", keys.alias("key"), value.alias("__n")))
            found |= {s: F.col("__found")[k] for k, s in own.items()}
    elif closures.table is not None:
        out = _together(out, names, dict(enumerate(sets)), closures.table.select("set_id", "key", value.alias("__n")))
        found = {s: F.col("__found")[k] for k, s in enumerate(sets)}
    full = tuple(range(closures.features))
    if full in closures.sets:
        own = closures.tuples.select(*[F.col(n).alias(f"f_{n}") for n in names], value.alias("__full"))
        out = _on_bins(out, own, names, [f"f_{n}" for n in names])
        found[full] = F.col("__full")
    sizes = F.array(*[F.coalesce(found[s], nothing) for s in closures.sets])
    return out.select(*frame.columns, sizes.alias("sizes"))


def _together(frame: DataFrame, names: Sequence[str], sets: Mapping[int, FeatureSet], table: DataFrame) -> DataFrame:
    """``frame`` with ``__found``: by set, the ``__n`` of the table (``set_id``, ``key``) for the row's bins."""
    pairs = [F.struct(F.lit(k).alias("set_id"), _key(s).alias("key")) for k, s in sets.items()]
    probes = frame.select(*names).distinct().select(*names, F.inline(F.array(*pairs)))
    hits = probes.join(table, ["set_id", "key"])
    maps = hits.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("set_id", "__n"))).alias("__found"))
    return _on_bins(frame, maps.select(*[F.col(n).alias(f"p_{n}") for n in names], "__found"), names, [f"p_{n}" for n in names])


def _on_bins(left: DataFrame, right: DataFrame, names: Sequence[str], others: Sequence[str], spread: bool = True) -> DataFrame:
    """A left join on bins. ``spread`` adds their hash as a key: the counts then don't keep the partitions in which
    they were aggregated, both sides are exchanged, and a tuple with very many rows can be split as a skewed join."""
    condition = F.lit(True)
    for n, o in zip(names, others, strict=True):
        condition = condition & (F.col(n) == F.col(o))
    if spread:
        left, right = left.withColumn("__lh", F.xxhash64(*names)), right.withColumn("__rh", F.xxhash64(*others))
        condition = condition & (F.col("__lh") == F.col("__rh"))
    return left.join(right, condition, "left").drop(*others, "__lh", "__rh")


def sizes_of(data: Dataset, closures: Closures, count: str, keep: Sequence[str] = ()) -> DataFrame:
    """The id, the columns of ``keep`` and ``sizes`` of each row."""
    closures.quantizer.check(data)
    binned = data.df.select(data.id_col, *keep, *closures.quantizer.bins())
    return look_up(binned, closures, count).select(data.id_col, *keep, "sizes")


def long_form(frame: DataFrame, column: str, keep: Sequence[str], value: str) -> DataFrame:
    """A row for each set: ``ctx_id`` and the array's value there."""
    return frame.select(*keep, F.posexplode(column).alias("ctx_id", value))
