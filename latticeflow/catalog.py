"""The registered queries of the engine, each with its SQL.

Models and SQL are made from the same declaration (table, features, bins, sets), so that both sides say one thing.
Degrees and scores are rounded to nine places on both sides, as the order of a sum may differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import closures as closure_ops
from .operators.classifier import CNClassifier
from .operators.context import FormalContext, nominal_incidence
from .operators.metrics import auc
from .operators.outlier import SODModel, UODModel
from .operators.quantize import fit_quantizer
from .operators.training import GradientDescent
from .plans.feature_sets import ConfigurableSelector, FeatureSet, name_of, pairs_of
from .sources.dataset import Dataset, factorize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@dataclass(frozen=True)
class Source:
    """A table with roles, for the engine and for SQL. ``frame`` may derive columns; ``sql`` is the same relation."""

    name: str
    id_col: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    label: str | None = None
    bins: int = 32
    frame: Callable[[SparkSession, str], DataFrame] | None = None
    sql: str | None = None
    sets: tuple[FeatureSet, ...] | None = None

    def data(self, spark: SparkSession, sf_dir: str) -> Dataset:
        df = self.frame(spark, sf_dir) if self.frame else table(spark, sf_dir, self.name)
        return Dataset(df, self.id_col, self.numeric, self.categorical, self.label)

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def all_sets(self) -> list[FeatureSet]:
        return [*self.sets] if self.sets else ConfigurableSelector()(len(self.features))

    def relation(self, where: str = "") -> str:
        return f"(SELECT * FROM {self.sql or self.name}{where})"

    def ctes(self, train: str = "", probe: str | None = None) -> str:
        """``t`` (training rows) and ``q`` (rows to score) with bins ``b0``, ... under the training ranges."""
        ranges = ", ".join(f"min({c})::DOUBLE AS lo{i}, max({c})::DOUBLE AS hi{i}" for i, c in enumerate(self.numeric)) or "1 AS one"
        bins = [f"CASE WHEN {c} IS NULL THEN -1 WHEN hi{i} = lo{i} THEN 0 ELSE least(greatest(floor(({c}::DOUBLE - lo{i}) / (hi{i} - lo{i}) * {self.bins}), 0), {self.bins - 1})::INT END AS b{i}" for i, c in enumerate(self.numeric)]
        bins += [f"coalesce('v' || {c}, 'n') AS b{i + len(self.numeric)}" for i, c in enumerate(self.categorical)]
        keep = f"{self.id_col}" + (f", {self.label}" if self.label else "")
        part = lambda name, where: f"{name} AS (SELECT {keep}, {', '.join(bins)} FROM {self.relation(where)}, r)"
        return f"WITH r AS (SELECT {ranges} FROM {self.relation(train)}), {part('t', train)}, {part('q', train if probe is None else probe)}"

    def degrees(self, count: str = "count(*)", train: str = "", probe: str | None = None) -> str:
        """``d``: the id and a row for each set with its ``ctx_id``, closure size ``n`` and ``degree``."""
        rows = []
        for k, s in enumerate(self.all_sets):
            keys = ", ".join(f"b{i}" for i in s)
            on = " AND ".join(f"q.b{i} = g.b{i}" for i in s)
            rows.append(f"SELECT q.{self.id_col} AS id, {k} AS ctx_id, coalesce(g.n, 0) AS n FROM q LEFT JOIN (SELECT {keys}, {count} AS n FROM t GROUP BY {keys}) g ON {on}")
        return f"{self.ctes(train, probe)}, s AS ({' UNION ALL '.join(rows)}), d AS (SELECT *, exp(-pow(n, 2)) AS degree FROM s)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(labels, "doc_id")


#: Elements of an embedding.
WIDTH = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(WIDTH)])


_DOC_SQL = "(SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))"
LINES = Source("lineitem", "l_orderkey", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"))
CUSTOMERS = Source("customer", "c_custkey", ("c_acctbal",), ("c_mktsegment", "c_nationkey"))
PARTS = Source("part", "p_partkey", ("p_size", "p_retailprice"), ("p_brand", "p_type"), bins=16)
SUPPLIERS = Source("supplier", "s_suppkey", ("s_acctbal",), ("s_nationkey",), bins=8)
ORDERS = Source("orders", "o_orderkey", ("o_orderkey", "o_totalprice"), (), bins=32)
EVENTS = Source("events", "event_id", ("value",), ("event_type",))
DOCS = Source("documents", "doc_id", ("n_chars",), ("lang", "source"), "toxic", 16, _documents, _DOC_SQL)
VECTORS = Source("embeddings", "vec_id", tuple(f"e{i}" for i in range(WIDTH)), (), "label", 3, _vectors, "(SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(WIDTH)) + " FROM embeddings)")
LINE_CLASSES = Source("lineitem", "l_orderkey", ("l_quantity", "l_discount"), ("l_linestatus",), "flag", 8, lambda s, d: table(s, d, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)), "(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem)")


def _mean_sql(s: Source, **how: str) -> str:
    return f"{s.degrees(**how)} SELECT id AS {s.id_col}, round(sum(degree) / {len(s.all_sets)}, 9) AS score FROM d GROUP BY id"


def _r(c: str | Column) -> Column:
    return F.round(c, 9)


def _uod(s: Source, spark: SparkSession, sf_dir: str) -> tuple[UODModel, Dataset]:
    data = s.data(spark, sf_dir)
    return UODModel(n=s.bins).fit(data), data


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupervised outlier scores of line items, which have no key of their own."""
    model, data = _uod(LINES, spark, sf_dir)
    return model.predict(data).withColumn("score", _r("score"))


# -- ranges, bins, categories, cells ---------------------------------------------------------------------------------


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS feature, '{c}' AS name, min({c}) AS low, max({c}) AS high FROM lineitem" for i, c in enumerate(LINES.numeric)) + ")")
def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINES.data(spark, sf_dir).ranges()


@query("SELECT count(*) AS rows, 6::INT AS features, 4::INT AS real_features, 2::INT AS categorical_features FROM lineitem")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = LINES.data(spark, sf_dir)
    return d.df.agg(F.count("*").alias("rows"), F.lit(d.feature_count()).alias("features"), F.lit(d.real_feature_count()).alias("real_features"), F.lit(d.categorical_feature_count()).alias("categorical_features"))


def _bins_query(s: Source, n: int | dict[str, int]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = s.data(spark, sf_dir)
        return d.df.select(F.col(s.id_col).alias("id"), *fit_quantizer(d, n).bins())

    return run


@query(f"{ORDERS.ctes()} SELECT o_orderkey AS id, b0, b1 FROM q")
def quantize_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins_query(ORDERS, 32)(spark, sf_dir)


@query(f"{PARTS.ctes().replace(' * 16)', ' * 5)', 1).replace('), 15)::INT', '), 4)::INT', 1)} SELECT p_partkey AS id, b0, b1, b2, b3 FROM t".replace("), q AS", "), unused AS"))
def quantize_per_feature_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins_query(PARTS, {"p_size": 5, "p_retailprice": 16})(spark, sf_dir)


@query(f"{ORDERS.ctes()} SELECT o_orderkey AS id, least(greatest(b0 - 4, 0), 7) AS clamped FROM q")
def safe_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins_query(ORDERS, 32)(spark, sf_dir).select("id", scalar.safe_bin(F.col("b0") - 4, 8).alias("clamped"))


@query("WITH f AS (SELECT c_mktsegment AS v, min(c_custkey) AS k FROM customer GROUP BY 1), c AS (SELECT v, (row_number() OVER (ORDER BY k) - 1)::INT AS code FROM f) SELECT c_custkey, c_mktsegment, code FROM customer JOIN c ON c_mktsegment = v")
def factorize_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorize(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("SELECT 2::INT AS feature, 'p_brand' AS name, count(DISTINCT p_brand) AS cardinality FROM part UNION ALL SELECT 3, 'p_type', count(DISTINCT p_type) FROM part")
def category_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PARTS.data(spark, sf_dir).cardinality()


@query("SELECT max(quality) + 1 AS quality_classes, max(toxic) + 1 AS toxic_classes FROM labels")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    counts = [Dataset(labels, "doc_id", (feature,), label=label).class_count().withColumnRenamed("n", f"{label}_classes") for label, feature in (("quality", "toxic"), ("toxic", "quality"))]
    return counts[0].crossJoin(counts[1])  # a row each


@query("SELECT s_suppkey, 0::INT AS feature, s_acctbal AS number, NULL::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 1, NULL, s_nationkey::VARCHAR FROM supplier")
def melt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUPPLIERS.data(spark, sf_dir).melt()


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def real_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUPPLIERS.data(spark, sf_dir).column(0)


@query("SELECT s_nationkey FROM supplier WHERE s_suppkey = 3")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUPPLIERS.data(spark, sf_dir).cell(3, 1)


@query(f"SELECT doc_id, toxic FROM {_DOC_SQL}")
def label_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DOCS.data(spark, sf_dir).labels()


@query(f"SELECT doc_id FROM {_DOC_SQL} WHERE toxic = 0")
def inlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DOCS.data(spark, sf_dir).inliers().select("doc_id")


# -- feature sets ----------------------------------------------------------------------------------------------------


def _sets_sql(sets: Sequence[FeatureSet], names: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT {k}::INT AS ctx_id, '{','.join(map(str, s))}' AS features, '{name_of(s, names)}' AS feature_set" for k, s in enumerate(sets))


@query(
    "WITH f AS (SELECT unnest(range(6))::INT AS i, ['l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus'] AS n), p AS (SELECT a.i, b.i AS j, (row_number() OVER (ORDER BY a.i, b.i) - 1)::INT AS ctx_id, a.n FROM f a JOIN f b ON a.i <= b.i) "
    "SELECT ctx_id, CASE WHEN i = j THEN i::VARCHAR ELSE i || ',' || j END AS features, CASE WHEN i = j THEN '{ ' || n[i + 1] || ' }' ELSE '{ ' || n[i + 1] || ', ' || n[j + 1] || ' }' END AS feature_set FROM p UNION ALL SELECT 21, '0,1,2,3,4,5', 'full'"
)
def feature_sets_pairs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.feature_sets import as_frame

    return as_frame(spark, LINES.all_sets, LINES.features).select("ctx_id", F.array_join(F.transform("features", lambda v: v.cast("string")), ",").alias("features"), "feature_set")


@query("WITH f AS (SELECT unnest(range(6))::INT AS i) SELECT a.i, b.i AS j FROM f a JOIN f b ON a.i <= b.i")
def feature_pairs_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(spark.range(6).select(F.col("id").cast("int").alias("i")))


@query(_sets_sql([(i,) for i in range(3)], CUSTOMERS.features))
def feature_sets_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.feature_sets import as_frame

    sets = ConfigurableSelector(doubletons=False, full=False)(3)
    return as_frame(spark, sets, CUSTOMERS.features).select("ctx_id", F.array_join(F.transform("features", lambda v: v.cast("string")), ",").alias("features"), "feature_set")


# -- contexts, closures, set operations ------------------------------------------------------------------------------


def _incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = CUSTOMERS.data(spark, sf_dir)
    return nominal_incidence(d, fit_quantizer(d, CUSTOMERS.bins))


_INCIDENCE_SQL = f"{CUSTOMERS.ctes()}, i AS (SELECT c_custkey AS obj_id, 0 AS feature, b0::VARCHAR AS bin FROM q UNION ALL SELECT c_custkey, 1, b1 FROM q UNION ALL SELECT c_custkey, 2, b2 FROM q)"


@query(f"{_INCIDENCE_SQL} SELECT obj_id, feature, bin FROM i")
def incidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incidence(spark, sf_dir)


@query(f"{_INCIDENCE_SQL} SELECT feature, bin, count(*) AS n FROM i GROUP BY ALL")
def extension_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incidence(spark, sf_dir).groupBy("feature", "bin").agg(F.count("*").alias("n"))


@query(f"{_INCIDENCE_SQL} SELECT obj_id, string_agg(feature || '=' || bin, ',' ORDER BY feature) AS attributes FROM i GROUP BY obj_id")
def intension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct("feature", F.concat("feature", F.lit("="), "bin").alias("a"))
    return _incidence(spark, sf_dir).groupBy("obj_id").agg(F.array_join(F.sort_array(F.collect_list(pair)).getField("a"), ",").alias("attributes"))


@query(f"{SUPPLIERS.ctes()} SELECT a.s_suppkey, b.s_suppkey AS member FROM q a JOIN t b ON a.b0 = b.b0 AND a.b1 = b.b1")
def closure_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of the closures of all objects: what is asked for has as many rows as all closures have members."""
    d = SUPPLIERS.data(spark, sf_dir)
    binned = d.df.select("s_suppkey", *fit_quantizer(d, SUPPLIERS.bins).bins())
    return binned.join(binned.withColumnRenamed("s_suppkey", "member"), ["b0", "b1"]).select("s_suppkey", "member")


def _general(spark: SparkSession, sf_dir: str) -> FormalContext:
    """Suppliers as objects; their nation and the 8 bins of their balance as attributes 0 to 24 and 100 to 107."""
    d = SUPPLIERS.data(spark, sf_dir)
    rows = d.df.select(F.col("s_suppkey").alias("obj_id"), "s_nationkey", *fit_quantizer(d, SUPPLIERS.bins).bins()[:1])
    return FormalContext(rows.select("obj_id", F.explode(F.array(F.col("s_nationkey").cast("int"), F.col("b0") + 100)).alias("attr_id")), rows.count(), 108)


_GENERAL_SQL = f"{SUPPLIERS.ctes()}, i AS (SELECT s_suppkey AS obj_id, substr(b1, 2)::INT AS attr_id FROM q UNION ALL SELECT s_suppkey, b0 + 100 FROM q)"


def _own_sql(obj: int) -> str:
    return f"(SELECT DISTINCT attr_id FROM i WHERE obj_id = {obj})"


def _attributes(context: FormalContext, obj: int) -> list[int]:
    return [r["attr_id"] for r in context.intension(obj).collect()]


@query(f"{_GENERAL_SQL} SELECT obj_id FROM i WHERE attr_id IN {_own_sql(1)} GROUP BY obj_id HAVING count(DISTINCT attr_id) = (SELECT count(*) FROM {_own_sql(1)})")
def closure_by_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that have both attributes of supplier 1, itself among them."""
    context = _general(spark, sf_dir)
    return context.closure(_attributes(context, 1))


@query(f"{_GENERAL_SQL} SELECT obj_id FROM i WHERE attr_id IN {_own_sql(2)} AND obj_id % 2 = 0 GROUP BY obj_id HAVING count(DISTINCT attr_id) = (SELECT count(*) FROM {_own_sql(2)})")
def filtered_closure_by_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of supplier 2, among those with an even key."""
    context = _general(spark, sf_dir)
    return context.closure(_attributes(context, 2), context.incidence.where("obj_id % 2 = 0").select("obj_id").distinct())


@query(f"{_GENERAL_SQL}, o AS (SELECT obj_id, list_sort(list(DISTINCT attr_id)) AS own FROM i GROUP BY 1) SELECT obj_id FROM o WHERE list_has_all(own, (SELECT own FROM o WHERE obj_id = 3))")
def closure_of_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _general(spark, sf_dir).closure_of(3)


@query(f"{_GENERAL_SQL}, o AS (SELECT obj_id, list_sort(list(DISTINCT attr_id)) AS own FROM i GROUP BY 1) SELECT a.obj_id, count(*) AS n FROM o a JOIN o b ON list_has_all(b.own, a.own) GROUP BY 1")
def closure_size_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _general(spark, sf_dir).closure_sizes()


def _sized(s: Source, sets: Sequence[FeatureSet], spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.data(spark, sf_dir)
    closures = closure_ops.build(d, fit_quantizer(d, s.bins), sets, {"n": F.lit(1)})
    sized = closure_ops.sizes_of(d, closures, "n")
    return closure_ops.long_form(sized, "sizes", [F.col(s.id_col).alias("id")], "n")


def _sizes_sql(s: Source, sets: tuple[FeatureSet, ...]) -> str:
    own = Source(s.name, s.id_col, s.numeric, s.categorical, s.label, s.bins, s.frame, s.sql, sets)
    return f"{own.degrees()} SELECT id, ctx_id, n FROM d"


_SINGLE, _PAIR, _FULL = ((0,), (1,), (2,), (3,)), ((0, 2), (1, 3)), ((0, 1, 2, 3),)


@query(_sizes_sql(PARTS, _SINGLE))
def closure_size_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(PARTS, _SINGLE, spark, sf_dir)


@query(_sizes_sql(PARTS, _PAIR))
def closure_size_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(PARTS, _PAIR, spark, sf_dir)


@query(_sizes_sql(PARTS, _FULL))
def closure_size_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(PARTS, _FULL, spark, sf_dir)


@query(
    f"{LINES.ctes()} SELECT k AS set_id, n, count(*) AS keys FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM t GROUP BY {', '.join(f'b{i}' for i in s)}" for k, s in enumerate(dict.fromkeys(x for x in LINES.all_sets if len(x) < 6)))
    + ") GROUP BY ALL"
)
def closure_size_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of each set have which closure size."""
    d = LINES.data(spark, sf_dir)
    closures = closure_ops.build(d, fit_quantizer(d, 32), LINES.all_sets, {"n": F.lit(1)})
    return closures.table.groupBy("set_id", "n").agg(F.count("*").alias("keys"))


@query(f"{DOCS.degrees('sum((toxic = 0)::INT)::BIGINT')} SELECT id AS doc_id, ctx_id, n FROM d")
def filtered_closure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DOCS.data(spark, sf_dir)
    model = SODModel(n=DOCS.bins).fit_closures(d)
    return closure_ops.long_form(closure_ops.sizes_of(d, model.closures, "n_inlier"), "sizes", ["doc_id"], "n")


@query("SELECT a.s_suppkey AS id, list_sort(list_intersect(range(a.s_suppkey % 5, 9), range(3, 3 + a.s_nationkey % 7)))::VARCHAR AS common FROM supplier a")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("sequence(cast(s_suppkey % 5 as bigint), 8L)")
    b = F.expr("if(s_nationkey % 7 = 0, cast(array() as array<bigint>), sequence(3L, cast(2 + s_nationkey % 7 as bigint)))")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("["), F.array_join(F.transform(scalar.intersect(a, b), lambda v: v.cast("string")), ", "), F.lit("]")).alias("common"))


@query("SELECT s_suppkey AS id, list_has_all(range(s_suppkey % 5, 9), range(3, 3 + s_nationkey % 7)) AS within, s_nationkey % 7 AS members FROM supplier")
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("sequence(cast(s_suppkey % 5 as bigint), 8L)")
    b = F.expr("if(s_nationkey % 7 = 0, cast(array() as array<bigint>), sequence(3L, cast(2 + s_nationkey % 7 as bigint)))")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), scalar.subset_of(b, a).alias("within"), scalar.set_size(b).alias("members"))


# -- unsupervised model ----------------------------------------------------------------------------------------------


@query(f"{CUSTOMERS.degrees()} SELECT id AS c_custkey, ctx_id, round(degree, 9) AS degree FROM d")
def outlier_degrees_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, data = _uod(CUSTOMERS, spark, sf_dir)
    return model.degrees_long(data).withColumn("degree", _r("degree"))


def _predict(s: Source) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, data = _uod(s, spark, sf_dir)
        return model.predict(data).withColumn("score", _r("score"))

    return run


@query(_mean_sql(CUSTOMERS))
def uod_predict_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict(CUSTOMERS)(spark, sf_dir)


@query(_mean_sql(EVENTS))
def uod_predict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict(EVENTS)(spark, sf_dir)


@query(
    f"{LINES.ctes()} SELECT l_orderkey, round(({' + '.join('exp(-pow(count(*) OVER (PARTITION BY ' + ', '.join(f'b{i}' for i in s) + '), 2))' for s in LINES.all_sets)}) / {len(LINES.all_sets)}, 9) AS score FROM q"
)
def uod_predict_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(_mean_sql(CUSTOMERS, train=" WHERE c_custkey % 4 <> 0", probe=" WHERE c_custkey % 4 = 0"))
def uod_predict_new_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = CUSTOMERS.data(spark, sf_dir)
    model = UODModel(n=CUSTOMERS.bins).fit(d.with_frame(d.df.where("c_custkey % 4 <> 0")))
    return model.predict(d.with_frame(d.df.where("c_custkey % 4 = 0"))).withColumn("score", _r("score"))


def _name_sql(s: Source) -> str:
    return "CASE ctx_id " + " ".join(f"WHEN {k} THEN '{name_of(x, s.features)}'" for k, x in enumerate(s.all_sets)) + " END"


@query(f"{PARTS.degrees()}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY degree DESC, ctx_id) AS rank FROM d) SELECT id AS p_partkey, rank::INT AS rank, {_name_sql(PARTS)} AS feature_set, round(degree, 9) AS relevance FROM k WHERE rank <= 3")
def uod_explain_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, data = _uod(PARTS, spark, sf_dir)
    return model.predict_explain(data).entries(3).select("p_partkey", "rank", "feature_set", _r("relevance").alias("relevance"))


# -- supervised model ------------------------------------------------------------------------------------------------

_W = [round(float(x), 4) for x in np.sin(np.arange(1, 8) * 1.7) + 0.3]
_W_PLUS, _W_MINUS = sum(w for w in _W if w > 0), sum(w for w in _W if w < 0)
_W_SQL = "CASE ctx_id " + " ".join(f"WHEN {k} THEN {w!r}::DOUBLE" for k, w in enumerate(_W)) + " END"
_INLIERS = "sum((toxic = 0)::INT)::BIGINT"


def _sod(spark: SparkSession, sf_dir: str) -> tuple[SODModel, Dataset]:
    d = DOCS.data(spark, sf_dir)
    return SODModel(n=DOCS.bins).fit_closures(d).set_weights(_W), d


@query(f"{DOCS.degrees(_INLIERS)} SELECT id AS doc_id, ctx_id, round(degree, 9) AS degree FROM d")
def sod_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _sod(spark, sf_dir)
    return closure_ops.long_form(model.degrees(d), "degrees", ["doc_id"], "degree").withColumn("degree", _r("degree"))


@query(f"{DOCS.degrees(_INLIERS)} SELECT id AS doc_id, round((sum({_W_SQL} * degree) - ({_W_MINUS!r}::DOUBLE)) / ({_W_PLUS + _W_MINUS!r}::DOUBLE), 7) AS score FROM d GROUP BY id")
def sod_predict_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _sod(spark, sf_dir)
    return model.predict(d).withColumn("score", F.round("score", 7))


@query(f"{DOCS.degrees(_INLIERS)}, e AS (SELECT *, {_W_SQL} * degree AS relevance FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY relevance DESC, ctx_id) AS rank FROM e) SELECT id AS doc_id, rank::INT AS rank, {_name_sql(DOCS)} AS feature_set, round(relevance, 9) AS relevance FROM k WHERE rank <= 3")
def sod_explain_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _sod(spark, sf_dir)
    return model.predict_explain(d).entries(3).select("doc_id", "rank", "feature_set", _r("relevance").alias("relevance"))


@query(f"SELECT round(count(*) / (count(*) - sum((toxic = 0)::INT)), 9) AS balance FROM {_DOC_SQL}")
def sod_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(_sod(spark, sf_dir)[0].statistics().balance, 9),)], "balance double")


def _gram_frame(spark: SparkSession, pairs: list[tuple[int, int, int, float]]) -> DataFrame:
    return spark.createDataFrame(pairs, "outlier int, i int, j int, value double")


@query(f"{DOCS.degrees(_INLIERS)}, y AS (SELECT doc_id, (toxic <> 0)::INT AS outlier FROM q) SELECT outlier, a.ctx_id::INT AS i, b.ctx_id::INT AS j, round(sum(a.degree * b.degree), 6) AS value FROM d a JOIN d b ON a.id = b.id JOIN y ON y.doc_id = a.id GROUP BY ALL")
def sod_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _sod(spark, sf_dir)[0].statistics()
    return _gram_frame(spark, [(c, i, j, round(float(g.G[i, j]), 6)) for c, g in enumerate((loss.inliers, loss.outliers)) for i in range(len(_W)) for j in range(len(_W))])


_SCORED = f"{DOCS.degrees(_INLIERS)}, y AS (SELECT doc_id, toxic FROM q), bal AS (SELECT count(*) / (count(*) - sum((toxic = 0)::INT)) AS balance FROM y), p AS (SELECT id, (sum({_W_SQL} * degree) - ({_W_MINUS!r}::DOUBLE)) / ({_W_PLUS + _W_MINUS!r}::DOUBLE) AS s, sum({_W_SQL} * degree) AS wd FROM d GROUP BY id)"


@query(f"{_SCORED} SELECT round(sum(CASE WHEN toxic = 0 THEN s * s / balance ELSE (1 - s) * (1 - s) END), 5) AS loss FROM p JOIN y ON p.id = doc_id, bal")
def sod_loss_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _sod(spark, sf_dir)[0].statistics()
    return spark.createDataFrame([(round(loss.loss(np.array(_W)), 5),)], "loss double")


@query(
    f"{_SCORED} SELECT ctx_id::INT AS ctx_id, round(sum(CASE WHEN toxic = 0 THEN 2 * s / balance ELSE -2 * (1 - s) END * ((degree - 1) * {_W_PLUS + _W_MINUS!r}::DOUBLE - wd)) / pow({_W_PLUS + _W_MINUS!r}::DOUBLE, 2), 5) AS gradient FROM d JOIN p USING (id) JOIN y ON id = doc_id, bal GROUP BY ctx_id"
)
def sod_gradient_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sod(spark, sf_dir)[0].statistics().gradient(np.array(_W))
    return spark.createDataFrame([(k, round(float(x), 5)) for k, x in enumerate(g)], "ctx_id int, gradient double")


_EPOCHS = 12
_START = GradientDescent(lambda w: 0.0, lambda w: w, len(_W)).weights
#: The statistics of the degrees by class, then the descent, an epoch in a row.
_TRAINED = f"""
{DOCS.degrees(_INLIERS).replace("WITH ", "WITH RECURSIVE ", 1)}, y AS (SELECT doc_id, (toxic <> 0)::INT AS outlier FROM q), e AS (SELECT id, ctx_id, degree, outlier FROM d JOIN y ON doc_id = id),
gm AS (SELECT outlier, list(gs ORDER BY i) AS g FROM (SELECT outlier, i, list(v ORDER BY j) AS gs FROM (SELECT a.outlier, a.ctx_id AS i, b.ctx_id AS j, sum(a.degree * b.degree) AS v FROM e a JOIN e b USING (id) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
sv AS (SELECT outlier, list(v ORDER BY ctx_id) AS s FROM (SELECT outlier, ctx_id, sum(degree) AS v FROM e GROUP BY ALL) GROUP BY ALL), kn AS (SELECT outlier, count(*)::DOUBLE AS k FROM y GROUP BY ALL),
mm AS (SELECT a.g AS g0, b.g AS g1, c.s AS s0, d.s AS s1, e.k AS k0, f.k AS k1, (e.k + f.k) / f.k AS balance FROM gm a, gm b, sv c, sv d, kn e, kn f WHERE a.outlier = 0 AND b.outlier = 1 AND c.outlier = 0 AND d.outlier = 1 AND e.outlier = 0 AND f.outlier = 1),
w AS (SELECT 0 AS epoch, {[float(x) for x in _START]}::DOUBLE[] AS w, {[0.0] * len(_W)}::DOUBLE[] AS step UNION ALL
  SELECT epoch + 1, list_transform(range(1, {len(_W) + 1}), lambda i: w[i] + now[i]), now FROM (
    SELECT epoch, w, list_transform(range(1, {len(_W) + 1}), lambda i: 0.01 * step[i] - 0.01 * (2 / balance * ((h0[i] / t + a0 * s0[i] - r0) / t - (list_dot_product(w, h0) / t + a0 * list_dot_product(w, s0)) / (t * t)) + 2 * ((h1[i] / t + a1 * s1[i] - r1) / t - (list_dot_product(w, h1) / t + a1 * list_dot_product(w, s1)) / (t * t)))) AS now FROM (
      SELECT *, list_dot_product(w, s0) / t + k0 * a0 AS r0, list_dot_product(w, s1) / t + k1 * a1 AS r1 FROM (
        SELECT *, -minus / t AS a0, -minus / t - 1 AS a1, list_transform(g0, lambda x: list_dot_product(x, w)) AS h0, list_transform(g1, lambda x: list_dot_product(x, w)) AS h1 FROM (
          SELECT *, list_sum(w) AS t, coalesce(list_sum(list_filter(w, lambda x: x < 0)), 0) AS minus FROM w, mm WHERE epoch < {_EPOCHS})))))
"""


def _trained(spark: SparkSession, sf_dir: str) -> tuple[SODModel, Dataset]:
    d = DOCS.data(spark, sf_dir)
    return SODModel(n=DOCS.bins, epochs=_EPOCHS, stop_threshold=0.0, show_training=False).fit(d), d


@query(f"{_TRAINED} SELECT (unnest(range({len(_W)})))::INT AS ctx_id, round(unnest(w), 5) AS weight FROM w WHERE epoch = {_EPOCHS}")
def sod_train_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights after a few epochs from the seeded start, which SQL is given."""
    weights = _trained(spark, sf_dir)[0].get_weights()
    return spark.createDataFrame([(k, round(float(x), 5)) for k, x in enumerate(weights)], "ctx_id int, weight double")


@query(
    f"{_TRAINED}, fitted AS (SELECT w, list_sum(w) AS t, coalesce(list_sum(list_filter(w, lambda x: x < 0)), 0) AS minus FROM w WHERE epoch = {_EPOCHS}) SELECT id AS doc_id, round((sum(w[ctx_id + 1] * degree) - any_value(minus)) / any_value(t), 4) AS score FROM d, fitted GROUP BY id"
)
def sod_train_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _trained(spark, sf_dir)
    return model.predict(d).withColumn("score", F.round("score", 4))


@query()
def sod_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained from a seed; the tests hold the statistics against the plain loss."""
    d = DOCS.data(spark, sf_dir)
    return SODModel(n=DOCS.bins, epochs=300, show_training=False).fit(d).predict(d)


# -- classifier ------------------------------------------------------------------------------------------------------


def _score_ctes(s: Source, classes: int) -> str:
    """``c``: for each row, set and class the class's share of the largest class's count."""
    rows = []
    for k, x in enumerate(s.all_sets):
        keys, on = ", ".join(f"b{i}" for i in x), " AND ".join(f"q.b{i} = g.b{i}" for i in x)
        counts = ", ".join(f"sum(({s.label} = {c})::INT)::DOUBLE AS n{c}" for c in range(classes))
        top = f"greatest({', '.join(f'coalesce(g.n{c}, 0)' for c in range(classes))})"
        rows += [f"SELECT {s.id_col} AS id, {k * classes + c} AS place, {c} AS class, CASE WHEN {top} > 0 THEN coalesce(g.n{c}, 0) / {top} ELSE 0 END AS score FROM q LEFT JOIN (SELECT {keys}, {counts} FROM t GROUP BY {keys}) g ON {on}" for c in range(classes)]
    return f"{s.ctes()}, c AS ({' UNION ALL '.join(rows)})"


def _fixed(classes: int, sets: int) -> np.ndarray:
    return np.round(np.cos(np.arange(classes * sets * classes) * 0.9), 4).reshape(classes, -1)


def _proba_ctes(s: Source, classes: int) -> str:
    w = _fixed(classes, len(s.all_sets))
    z = " UNION ALL ".join(f"SELECT id, {c} AS class, sum(score * [{', '.join(repr(float(x)) for x in w[c])}][place + 1]) AS z FROM c GROUP BY id" for c in range(classes))
    return f"{_score_ctes(s, classes)}, z AS ({z}), m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), p AS (SELECT id, class, e / sum(e) OVER (PARTITION BY id) AS p FROM m)"


#: All elements in sets of four neighbours.
VECTOR_ROWS = Source(VECTORS.name, VECTORS.id_col, VECTORS.numeric, (), "label", 3, VECTORS.frame, VECTORS.sql, tuple(tuple(range(i, i + 4)) for i in range(0, WIDTH, 4)))


def _cnc(spark: SparkSession, sf_dir: str) -> tuple[CNClassifier, Dataset]:
    d = VECTOR_ROWS.data(spark, sf_dir)
    model = CNClassifier(n=3, selector=lambda _: VECTOR_ROWS.all_sets).fit_closures(d)
    return model.set_weights(_fixed(len(model.classes), len(model.feature_sets))), d


@query(f"{_score_ctes(VECTOR_ROWS, 10)} SELECT id AS vec_id, place::INT AS place, round(score, 9) AS score FROM c")
def cnc_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _cnc(spark, sf_dir)
    return model.scores(d).select("vec_id", F.posexplode("scores").alias("place", "score")).withColumn("score", _r("score"))


@query(f"{_proba_ctes(VECTOR_ROWS, 10)} SELECT id AS vec_id, class::INT AS class, round(p, 8) AS p FROM p")
def cnc_proba_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _cnc(spark, sf_dir)
    return model.predict_proba(d).select("vec_id", F.posexplode("probabilities").alias("class", "p")).withColumn("p", F.round("p", 8))


@query(f"{_proba_ctes(VECTOR_ROWS, 10)} SELECT id AS vec_id, class::INT AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, class) AS k FROM p) WHERE k = 1")
def cnc_predict_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _cnc(spark, sf_dir)
    return model.predict(d)


@query(f"{_proba_ctes(VECTOR_ROWS, 10)}, y AS (SELECT vec_id, label FROM q) SELECT round(avg(-ln(p)), 7) AS loss FROM p JOIN y ON id = vec_id AND class = label")
def cnc_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, d = _cnc(spark, sf_dir)
    rows = model.predict_proba(d).join(d.labels(), "vec_id")
    return rows.agg(F.round(F.avg(scalar.softmax_cross_entropy(F.col("probabilities"), F.col("label"))), 7).alias("loss"))


@query(
    f"{LINE_CLASSES.ctes()}, h AS (SELECT b0, b1, b2, flag, count(*) AS n FROM t GROUP BY ALL) SELECT b0, b1, b2, flag AS label, n, round(n / max(n) OVER (PARTITION BY b0, b1, b2), 9) AS share FROM h"
)
def cnc_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of the closures of the full set, as shares of the largest."""
    d = LINE_CLASSES.data(spark, sf_dir)
    model = CNClassifier(n=8).fit_closures(d)
    counts = F.array(*[F.col(f"n{k}") for k in range(len(model.classes))])
    rows = model.closures.tuples.withColumn("h", counts).select("b0", "b1", "b2", "h", F.posexplode("h").alias("label", "n")).where("n > 0")
    return rows.select("b0", "b1", "b2", "label", "n", _r(F.col("n") / F.array_max("h")).alias("share"))


@query(f"{_proba_ctes(VECTOR_ROWS, 10)}, y AS (SELECT vec_id, label FROM q) SELECT p.class::INT AS class, place::INT AS place, round(avg((p - (label = p.class)::INT) * score), 7) AS gradient FROM p JOIN y ON p.id = vec_id JOIN c ON c.id = p.id GROUP BY ALL")
def cnc_gradient_fixed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivative of the mean cross-entropy over the training rows."""
    model, _ = _cnc(spark, sf_dir)
    gradient = model.loss_and_gradient(model.weights)[1]
    return spark.createDataFrame([(c, k, round(float(x), 7) + 0.0) for c, row in enumerate(gradient) for k, x in enumerate(row)], "class int, place int, gradient double")


@query()
def cnc_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = VECTOR_ROWS.data(spark, sf_dir)
    return CNClassifier(n=3, epochs=40, selector=lambda _: VECTOR_ROWS.all_sets).fit(d).predict(d)


# -- splits, metrics -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (o_orderkey % 4)::INT AS fold FROM orders")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ORDERS.data(spark, sf_dir).folds(4, order=F.col("o_orderkey")).select("o_orderkey", "fold")


@query("SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 4)::INT AS fold FROM orders")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by key, so that SQL can say the same; ``Dataset.folds`` ranks by a hash."""
    data = Dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey", ("o_totalprice",), label="o_orderstatus")
    return data.folds(4, stratified=True, order=F.col("o_orderkey")).select("o_orderkey", "o_orderstatus", "fold")


@query("SELECT o_orderkey, (('0x' || substr(md5(o_orderkey || ':42'), 1, 15))::BIGINT % 4)::INT AS fold FROM orders")
def kfold_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ORDERS.data(spark, sf_dir).folds(4).select("o_orderkey", "fold")


@query(
    f"WITH x AS (SELECT n_chars::DOUBLE AS s, quality FROM {_DOC_SQL}), r AS (SELECT *, rank() OVER (ORDER BY s) AS lo, count(*) OVER (PARTITION BY s) AS same FROM x), a AS (SELECT sum((quality <> 0)::INT) AS p, sum((quality = 0)::INT) AS n, sum(CASE WHEN quality <> 0 THEN lo + (same - 1) / 2 END) AS ranks FROM r) SELECT p::BIGINT AS n_pos, n::BIGINT AS n_neg, round((ranks - p * (p + 1) / 2) / (p * n), 9) AS auc FROM a"
)
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc(DOCS.data(spark, sf_dir).df, "n_chars", "quality").withColumn("auc", _r("auc"))
