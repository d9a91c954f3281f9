"""Loading of datasets: a registry of loaders by type, and of file readers by suffix."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from .dataset import Dataset, factorize

#: The id that a source without one gets: its place, counted once.
ROW_ID = "row_id"


def _spark(spark: SparkSession | None = None) -> SparkSession:
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise ValueError("there is no active Spark session")
    return found


def load(data: Any, *, categorical: Sequence[str] | str | None = None, labels: str | None = None, Xc: Any = None, y: Any = None, id_col: str | None = None, settings: Mapping[str, Any] | None = None, spark: SparkSession | None = None) -> Dataset:
    """A dataset from whatever ``loaders`` knows: a dataset, DataFrame, pandas frame, numpy matrix, or path.

    ``categorical`` names columns that are categories whatever their type; ``labels`` names the label column; ``Xc``
    (numpy, or columns of a frame to join by place or id) adds categories and ``y`` replaces the label.
    """
    names = [categorical] if isinstance(categorical, str) else list(categorical or ())
    for kind, loader in reversed(loaders.items()):
        if isinstance(data, kind):
            return loader(data, categorical=names, labels=labels, Xc=Xc, y=y, id_col=id_col, settings=dict(settings or {}), spark=spark)
    raise ValueError(f"there is no loader for {type(data).__name__}")


def same(data: Dataset, **_: Any) -> Dataset:
    return data


def _kept(df: DataFrame) -> DataFrame:
    """``df``, computed once: a checkpoint where the cluster names a folder for them, else persisted."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def from_frame(df: DataFrame, *, categorical: Sequence[str] = (), labels: str | None = None, Xc: Any = None, y: Any = None, id_col: str | None = None, **_: Any) -> Dataset:
    """Numeric columns are numeric features, string, boolean and named ones are categories; the label column is neither.

    A label that isn't numeric is numbered by first appearance. ``Xc`` and ``y`` are DataFrames with the id column.
    """
    if labels is not None and not isinstance(labels, str):
        raise TypeError("labels names one column")
    for c in [*categorical, *([labels] if labels else []), *([id_col] if id_col else [])]:
        if c not in df.columns:
            raise ValueError(f"no such column: {c}")
    if id_col is None:
        id_col = ROW_ID
        while id_col in df.columns:
            id_col += "_"
        df = _kept(df.withColumn(id_col, F.monotonically_increasing_id()))
    own = [f for f in df.schema.fields if f.name not in (id_col, labels)]
    numeric = [f.name for f in own if isinstance(f.dataType, NumericType) and f.name not in categorical]
    classes = [f.name for f in own if f.name in categorical or isinstance(f.dataType, (StringType, BooleanType))]
    if Xc is not None:
        classes += [c for c in Xc.columns if c != id_col]
        df = df.join(Xc, id_col)
    label = labels
    if y is not None:
        given = next(c for c in y.columns if c != id_col)
        label = labels or given
        df = df.drop(label).join(y.select(id_col, F.col(given).alias(label)), id_col)
    if label and not isinstance(df.schema[label].dataType, NumericType):
        df = factorize(df, label, id_col, "__label").drop(label).withColumnRenamed("__label", label)
    kept = [id_col, *numeric, *classes, *([label] if label else [])]
    return Dataset(df.select(*kept), id_col, tuple(numeric), tuple(classes), label)


def from_pandas(pdf: pd.DataFrame, *, categorical: Sequence[str] = (), labels: str | None = None, Xc: Any = None, y: Any = None, id_col: str | None = None, spark: SparkSession | None = None, **_: Any) -> Dataset:
    """As ``from_frame``; ids are places. ``y`` replaces the label column, which is never a feature."""
    if labels is not None and not isinstance(labels, str):
        raise TypeError("labels names one column")
    if labels is not None and labels not in pdf.columns:
        raise ValueError(f"no such column: {labels}")
    pdf = pdf.copy()
    name = labels or "label"
    if y is not None:
        pdf[name] = _vector(y, len(pdf))
        labels = name
    if Xc is not None:
        for k, column in enumerate(_matrix(Xc, len(pdf)).T):
            pdf[f"c{k}"] = column
            categorical = [*categorical, f"c{k}"]
    if id_col is None:
        id_col = ROW_ID
        pdf.insert(0, id_col, np.arange(len(pdf)))
    for c in pdf.columns:
        if isinstance(pdf[c].dtype, pd.CategoricalDtype) or pdf[c].dtype == object and c not in (id_col,):
            pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    return from_frame(_spark(spark).createDataFrame(pdf), categorical=categorical, labels=labels, id_col=id_col)


def _matrix(x: Any, rows: int | None = None) -> np.ndarray:
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("a matrix with two dimensions is needed")
    if rows is not None and len(x) != rows:
        raise ValueError(f"{rows} rows are needed, not {len(x)}")
    return x


def _vector(y: Any, rows: int) -> np.ndarray:
    y = np.asarray(y)
    if y.ndim > 1:
        y = _matrix(y)[:, 0]
    if len(y) != rows:
        raise ValueError(f"{rows} labels are needed, not {len(y)}")
    return y


def from_numpy(X: np.ndarray | None, *, Xc: Any = None, y: Any = None, spark: SparkSession | None = None, settings: Mapping[str, Any] | None = None, **_: Any) -> Dataset:
    """A numeric matrix (as double), a matrix of category codes (as int) and labels (as int); rows go by place."""
    if X is None and Xc is None:
        raise ValueError("numeric or categorical data is needed")
    named = settings or {}
    columns: dict[str, np.ndarray] = {}
    rows = len(X if X is not None else Xc)
    numeric, classes = [], []
    for part, prefix, own, kind, names in ((X, "x", numeric, np.float64, named.get("Xnames")), (Xc, "c", classes, np.int32, named.get("Xcnames"))):
        if part is not None:
            for k, column in enumerate(_matrix(part, rows).T):
                own.append(str(names[k]) if names else f"{prefix}{k}")
                columns[own[-1]] = column.astype(kind)
    label = None
    if y is not None:
        label = str(named.get("yname", "label"))
        columns[label] = _vector(y, rows).astype(np.int32)
    pdf = pd.DataFrame({ROW_ID: np.arange(rows, dtype=np.int64)} | columns)
    schema = ", ".join(f"`{c}` {'long' if c == ROW_ID else 'double' if c in numeric else 'int'}" for c in pdf.columns)
    return Dataset(_spark(spark).createDataFrame(pdf, schema), ROW_ID, tuple(numeric), tuple(classes), label)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _csv(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)


def _json(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    """JSON lines, an array of records, or one document of columns (name to place to value), which is unrolled."""
    first = (spark.read.text(path).where("trim(value) <> ''").first() or [""])[0].strip()
    df = spark.read.options(**({"multiLine": not (first.startswith("{") and first.endswith("}"))} | options)).json(path)
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    if kinds and all(k == "struct" for k in kinds):
        places = df.schema.fields[0].dataType.fieldNames()
        columns = [F.array(*[F.col(f"`{c}`.`{p}`") for p in places]).alias(c) for c in df.columns]
        return df.select(F.inline(F.arrays_zip(*columns)))
    return df


def _parquet(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def _orc(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    return spark.read.options(**options).orc(path)


def _sql(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    """The rows of the query that the file holds, over the session's tables and views."""
    return spark.sql(spark.read.text(path, wholetext=True).first()[0], **options)


def _xlsx(spark: SparkSession, path: str, options: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame(pd.read_excel(path, **options))  # needs openpyxl; a sheet fits on the driver


#: Readers by suffix: (session, path, options of ``settings["parse"]``) to a DataFrame.
readers: dict[str, Callable[[SparkSession, str, Mapping[str, Any]], DataFrame]] = {".csv": _csv, ".json": _json, ".jsonl": _json, ".parquet": _parquet, ".orc": _orc, ".sql": _sql, ".xlsx": _xlsx}


def _mat(path: str, settings: Mapping[str, Any]) -> dict[str, np.ndarray | None]:
    """The matrices of a MATLAB file: by scipy up to version 7.2, by h5py (transposed) from 7.3 on."""
    names = {part: settings.get(f"{part}name", part) for part in ("X", "Xc", "y")}
    try:
        from scipy.io import loadmat

        held = loadmat(path)
        return {part: held.get(name) for part, name in names.items()}
    except (ImportError, NotImplementedError):
        import h5py

        with h5py.File(path, "r") as held:
            return {part: np.array(held[name]).T if name in held else None for part, name in names.items()}


def from_path(path: str, *, settings: Mapping[str, Any], spark: SparkSession | None = None, Xc: Any = None, y: Any = None, **roles: Any) -> Dataset:
    """A file or folder by its suffix; the options of its reader are ``settings["parse"]``."""
    session = _spark(spark)
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix not in readers and suffix != ".mat":
        raise ValueError(f"there is no reader for {suffix or 'a path without a suffix'}")
    if not _exists(session, str(path)):
        raise OSError(f"no such file: {path}")
    if suffix == ".mat":
        parts = _mat(str(path), settings)
        return from_numpy(parts["X"], Xc=Xc if Xc is not None else parts["Xc"], y=y if y is not None else parts["y"], spark=session)
    if suffix == ".xlsx":
        return from_pandas(pd.read_excel(path, **settings.get("parse", {})), Xc=Xc, y=y, spark=session, **roles)
    return from_frame(readers[suffix](session, str(path), settings.get("parse", {})), Xc=Xc, y=y, **roles)


#: Loaders by type, later ones first; users may add their own.
loaders: dict[type, Callable[..., Dataset]] = {str: from_path, PurePosixPath: from_path, type(None): from_numpy, np.ndarray: from_numpy, pd.DataFrame: from_pandas, DataFrame: from_frame, Dataset: same}
