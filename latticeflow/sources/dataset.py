"""A DataFrame with roles: id, numeric and categorical features, label."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import category, number
from ..plans.feature_sets import FeatureSet, feature_name, name_of


@dataclass(frozen=True)
class Dataset:
    """Features keep their order: numeric ones first, then categorical ones; a feature's id is its place there."""

    df: DataFrame
    id_col: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    label: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "numeric", tuple(self.numeric))
        object.__setattr__(self, "categorical", tuple(self.categorical))
        if not self.features:
            raise ValueError("a dataset needs a numeric or a categorical feature")
        wanted = [self.id_col, *self.features, *([self.label] if self.label else [])]
        missing = [c for c in wanted if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if len(set(self.features)) < len(self.features) or self.label in self.features:
            raise ValueError("a column can have one role only")

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def names(self) -> list[str]:
        return [*self.features]

    def size(self) -> int:
        return self.df.count()

    def feature_count(self) -> int:
        return len(self.features)

    def real_feature_count(self) -> int:
        return len(self.numeric)

    def categorical_feature_count(self) -> int:
        return len(self.categorical)

    def feature_name(self, i: int) -> str:
        return feature_name(i, self.names)

    def feature_set_to_str(self, features: FeatureSet) -> str:
        return name_of(features, self.names)

    def _renamed(self, own: tuple[str, ...], names: Sequence[str] | Mapping[str, int]) -> Dataset:
        if isinstance(names, Mapping):
            new = list(own)
            for name, k in names.items():
                if not 0 <= k < len(own):
                    raise RuntimeError(f"no feature {k}")
                new[k] = name
        elif isinstance(names, (list, tuple)):
            new = list(names)
        else:
            raise TypeError("names are a list, or a mapping from a name to its place")
        if len(new) != len(own):
            raise RuntimeError(f"{len(own)} names are needed")
        to = dict(zip(own, new, strict=True))
        rename = lambda cols: tuple(to.get(c, c) for c in cols)
        return replace(self, df=self.df.withColumnsRenamed(to), numeric=rename(self.numeric), categorical=rename(self.categorical), label=to.get(self.label, self.label))

    def set_real_names(self, names: Sequence[str] | Mapping[str, int]) -> Dataset:
        return self._renamed(self.numeric, names)

    def set_categorical_names(self, names: Sequence[str] | Mapping[str, int]) -> Dataset:
        return self._renamed(self.categorical, names)

    def set_labels_name(self, name: str) -> Dataset:
        if self.label is None:
            raise RuntimeError("there is no label")
        return self._renamed((self.label,), [name])

    def numeric_part(self) -> DataFrame:
        return self.df.select(self.id_col, *self.numeric)

    def categorical_part(self) -> DataFrame:
        return self.df.select(self.id_col, *self.categorical)

    def labels(self) -> DataFrame:
        if self.label is None:
            raise ValueError("there is no label")
        return self.df.select(self.id_col, self.label)

    def cell(self, row_id: object, feature: int) -> DataFrame:
        return self.df.where(F.col(self.id_col) == F.lit(row_id)).select(self.features[feature])

    def column(self, feature: int) -> DataFrame:
        return self.df.select(self.id_col, self.features[feature])

    def melt(self) -> DataFrame:
        """A row for each cell: id, ``feature``, ``number`` (of numeric ones) and ``value`` (of categorical ones)."""
        cells = [F.struct(F.lit(i).alias("feature"), number(c).alias("number"), F.lit(None).cast("string").alias("value")) for i, c in enumerate(self.numeric)]
        cells += [F.struct(F.lit(i + len(self.numeric)).alias("feature"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("value")) for i, c in enumerate(self.categorical)]
        return self.df.select(self.id_col, F.inline(F.array(*cells)))

    def inliers(self) -> DataFrame:
        """The rows whose label is 0."""
        return self.df.where(F.col(self._label()) == 0)

    def _label(self) -> str:
        if self.label is None:
            raise ValueError("this needs a label")
        return self.label

    def cardinality(self) -> DataFrame:
        """``feature``, ``name`` and ``cardinality`` of each categorical feature; nulls don't count."""
        counts = self.df.agg(*[F.count_distinct(c).alias(f"c{k}") for k, c in enumerate(self.categorical)])
        rows = [F.struct(F.lit(k + len(self.numeric)).alias("feature"), F.lit(c).alias("name"), F.col(f"c{k}").alias("cardinality")) for k, c in enumerate(self.categorical)]
        return counts.select(F.inline(F.array(*rows)))

    def ranges(self) -> DataFrame:
        """``feature``, ``name``, ``low`` and ``high`` of each numeric feature, in one pass; NaN counts as null."""
        both = self.df.agg(*[f(number(c)).alias(f"{n}{k}") for k, c in enumerate(self.numeric) for n, f in (("low", F.min), ("high", F.max))])
        rows = [F.struct(F.lit(k).alias("feature"), F.lit(c).alias("name"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k, c in enumerate(self.numeric)]
        return both.select(F.inline(F.array(*rows)))

    def with_frame(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def split(self, splitter: object) -> Iterator[tuple[Dataset, Dataset]]:
        """Train and test sets of any object whose ``split(ids[, labels])`` yields pairs of places.

        Such splitters work on places in one process, so the ids (and labels) come to the driver; ``kfold`` and
        ``stratified_kfold`` stay on the cluster.
        """
        cols = [self.id_col, *([self.label] if self.label else [])]
        rows = self.df.select(*cols).orderBy(self.id_col).collect()
        ids = [r[0] for r in rows]
        labels = [r[1] for r in rows] if self.label else None
        kind = self.df.schema[self.id_col].dataType.simpleString()
        pick = lambda places: self.df.sparkSession.createDataFrame([(ids[int(p)],) for p in places], f"`{self.id_col}` {kind}")
        for train, test in splitter.split(ids, labels):
            yield tuple(self.with_frame(self.df.join(pick(p), self.id_col, "left_semi")) for p in (train, test))

    def class_count(self) -> DataFrame:
        """``n``: one more than the largest label; labels are numbered from 0."""
        return self.df.agg((F.max(self._label()) + 1).alias("n"))

    def folds(self, k: int, seed: int = 42, stratified: bool = False, order: Column | None = None) -> DataFrame:
        """The rows with their ``fold``: by a hash of the id, or by rank within the label in hash order.

        ``order`` (a whole number, if not stratified) takes the hash's place.
        """
        hashed = order if order is not None else hash_of(F.col(self.id_col), seed)
        if not stratified:
            return self.df.withColumn("fold", F.pmod(hashed, F.lit(k)).cast("int"))
        return stratified_folds(self.df, self._label(), hashed, self.id_col, k)

    def kfold(self, k: int, seed: int = 42, stratified: bool = False) -> Iterator[tuple[Dataset, Dataset]]:
        rows = self.folds(k, seed, stratified)
        for fold in range(k):
            yield tuple(self.with_frame(rows.where(c).drop("fold")) for c in (F.col("fold") != fold, F.col("fold") == fold))


def hash_of(value: Column, seed: int) -> Column:
    """60 bits of the MD5 of a value and a seed, which every SQL can say too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", value.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores until no column of ``df`` has them (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Ranges into which an order falls, and values that are sampled to cut them.
RANGES, SAMPLED = 200, 4000


def range_of(frame: DataFrame, column: str) -> Column:
    """The number of the range, of about ``RANGES`` equal ones, that a row's value falls into; larger values, larger ranges.

    The cuts come from ``SAMPLED`` values, those with the least hashes, so that they are the same whenever they are read.
    """
    held = frame.select(column).where(F.col(column).isNotNull()).distinct()
    values = sorted(r[0] for r in held.orderBy(F.xxhash64(column), column).limit(SAMPLED).collect())
    cuts = sorted({values[k * len(values) // RANGES] for k in range(1, RANGES)}) if len(values) > RANGES else values
    if not cuts:
        return F.lit(0)
    kind = frame.schema[column].dataType
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(column))), F.lit(0))


def stratified_folds(df: DataFrame, label: str, order: Column, id_col: str, k: int) -> DataFrame:
    """``fold``: the rank within the label, modulo ``k``, however many rows a label has.

    Ranks are counted within ranges of the order, so that no label is one task, and start from the rows of the label's
    ranges before; those counts are ``RANGES`` rows a label.
    """
    at, part, rank, n, own_label, own_part, before = free_names(df, "order", "part", "rank", "n", "own_label", "own_part", "before")
    ordered = df.withColumn(at, order)
    keyed = ordered.withColumn(part, range_of(ordered, at))
    sizes = keyed.groupBy(F.col(label).alias(own_label), F.col(part).alias(own_part)).agg(F.count("*").alias(n))
    earlier = W.partitionBy(own_label).orderBy(own_part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(own_label, own_part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    ranked = keyed.withColumn(rank, F.row_number().over(W.partitionBy(label, part).orderBy(at, id_col)))
    joined = ranked.join(starts, F.col(label).eqNullSafe(F.col(own_label)) & (F.col(part) == F.col(own_part)))
    return joined.withColumn("fold", F.pmod(F.col(rank) - 1 + F.col(before), F.lit(k)).cast("int")).drop(at, part, rank, own_label, own_part, before)


def factorize(df: DataFrame, value: str, order: str, code: str = "code") -> DataFrame:
    """``df`` with the value's number by first appearance (in ``order``); -1 for null.

    The codes are a table of the distinct values; it is joined, and broadcast only if Spark finds it small. Values are
    numbered within ranges of their first appearance, from the number of values in the ranges before (``RANGES`` rows).
    """
    own, first, part, n, before, number, found = free_names(df, "own_value", "first", "part", "n", "before", "number", "found")
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias(own)).agg(F.min(order).alias(first))
    placed = seen.withColumn(part, range_of(seen, first))
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows
    starts = sizes.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    numbered = placed.withColumn(number, F.row_number().over(W.partitionBy(part).orderBy(first, own)))
    codes = numbered.join(F.broadcast(starts), part).select(own, (F.col(before) + F.col(number) - 1).cast("int").alias(found))
    return df.join(codes, F.col(value) == F.col(own), "left").withColumn(code, F.coalesce(found, F.lit(-1))).drop(own, found)


def category_keys(data: Dataset) -> dict[str, object]:
    return {c: category(c) for c in data.categorical}
