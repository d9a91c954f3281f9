"""Caches with repeated digests, label columns that aren't languages, and where intermediate tables go."""

import pytest

pytest.importorskip("latticeflow.llm")
from types import SimpleNamespace  # noqa: E402

from latticeflow.llm import _common, language_id, queries, token_counts  # noqa: E402

from .cases import odd  # noqa: E402


def test_cache_with_repeated_digests(spark):
    """As a replayed append or two writers leave it; a later call encodes nothing."""
    cache, model = f"{_common.Scratch(spark, 't').root}/c", queries.piece_model()
    rows = lambda: sorted(token_counts.count_tokens(odd(spark), model, cache).collect(), key=str)
    want = rows()
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    n = spark.read.parquet(cache).count()
    assert rows() == want and len(want) == odd(spark).count()
    assert spark.read.parquet(cache).count() == n


def test_many_labels_are_refused(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        language_id.fit(docs)


def test_shared_folder():
    def session(master, conf=None, context_dir=None):
        context = SimpleNamespace(master=master, applicationId="a", getConf=lambda: {}, getCheckpointDir=lambda: context_dir)
        return SimpleNamespace(conf=conf or {}, sparkContext=context)

    assert _common.shared_dir(session("yarn", {"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert _common.shared_dir(session("yarn", context_dir="hdfs:///y")) == "hdfs:///y"
    for master in ("yarn", "local-cluster[2,1,512]", "spark://host:7077"):
        with pytest.raises(ValueError):
            _common.shared_dir(session(master))
    assert _common.shared_dir(session("local[8]")).startswith("file://")
