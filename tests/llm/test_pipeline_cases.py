"""The pipeline as it is: near copies by bits or shingles, odd rows, empty tables and clashing names."""

from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from latticeflow.llm import quality, queries  # noqa: E402

from .cases import empty, odd  # noqa: E402
from .test_groups import plain_repeated  # noqa: E402
from .test_resemblance import plain_kept  # noqa: E402
from .test_rows import check_packing  # noqa: E402
from .test_search import plain_leaks  # noqa: E402


def test_whole_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    verdict = quality.judge(pa.array([r["text"] or "" for r in rows]), [r["lang"] for r in rows], queries.piece_model().load())["kept"]
    rows = sorted((r for r, k in zip(rows, verdict, strict=True) if k), key=lambda r: r["doc_id"])
    gone = plain_repeated(rows, 50)
    for r in rows:
        if own := gone[r["doc_id"], r["text"]]:
            r["text"] = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in own)
            r["n_chars"] = len(r["text"])
    kept, _ = plain_kept([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] in {*kept}]
    leaks = {d for d, *_ in plain_leaks([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    rows = [r for r in rows if r["doc_id"] not in leaks]
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf)
        assert found.columns == docs.columns, name
    assert Counter(tuple(r.asDict().items()) for r in found.collect()) == Counter(tuple(r.items()) for r in rows)
    check_packing(corpus_pipeline.run(spark, sf).collect(), rows, 2048)


NAMES = ("removed_lines", "own_id", "own_key", "gone_lines", "cell", "unit", "root", "fp", "bands", "key")


@pytest.mark.parametrize("make", [odd, empty])
def test_odd_rows_empty_tables_and_names(spark, sf, make):
    docs = make(spark).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in NAMES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "best_fit_packing":
            n = out.select("doc_id", "piece").distinct().count()
            assert n >= docs.select("doc_id").distinct().count()
        else:
            assert out.columns == docs.columns, name
            left = Counter(r["doc_id"] for r in out.collect()) - Counter(r["doc_id"] for r in docs.collect())
            assert not left, name
            if name != "quality_rules":
                assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
    found = docs
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, found, sf)
    found.collect()
