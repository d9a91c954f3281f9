"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null reads as the empty text; nothing else may change, as
every byte counts); a tokenizer's key is the SHA-256 of its file and library version. Counts are kept in a Parquet
table partitioned by tokenizer. A call joins the documents' digests to the stored counts, encodes one text for
each digest that is missing, appends those counts, and joins them back. A digest may be stored more than once, as two
writers at a time or a replayed append leave it; it counts once.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null ``doc_id`` and repeated rows pass through,
one result row for each input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, documents, map_rows
from .vocab import ModelFile

CACHE = "digest binary, n_tokens long, tokenizer string"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs, id_col=id_col, text_col=text_col).select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def stored(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """The counts that the cache has for a tokenizer version, a row for each digest; none if the cache doesn't exist yet."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: ModelFile, cache: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row.

    Writes the counts of texts that ``cache`` lacks before it returns.
    """
    keyed = _keyed(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "counts")  # joins on written tables can split a digest with very many rows
    known = scratch.put(stored(docs, cache, model.version), "known")
    missing = keyed.select("digest", "text") if known.isEmpty() else keyed.select("digest", "text").join(known, "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))

    def make():
        encoder = model.load()

        def work(batch):
            _, offsets = encoder.encode_all(batch.column("text"))
            yield {"digest": batch.column("digest"), "n_tokens": np.diff(offsets)}

        return work

    counted = map_rows(distinct, "digest binary, n_tokens long", make)
    counted.withColumn("tokenizer", F.lit(model.version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = scratch.put(stored(docs, cache, model.version), "counts")
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
