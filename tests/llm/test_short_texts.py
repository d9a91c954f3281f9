"""Clean texts stay in the quality stage, however short."""

import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
import corpus_pipeline  # noqa: E402

from latticeflow.llm import quality, queries  # noqa: E402


def test_stretches_of_kept_texts_stay(spark, sf):
    """What is kept whole isn't junk for being short; the median stretch has 72 tokens."""
    encoder = queries.piece_model().load()
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    whole = quality.judge(pa.array([r["text"] for r in rows]), [r["lang"] for r in rows], encoder)["kept"]
    texts, languages = [], []
    for r, kept in zip(rows, whole, strict=True):
        words = r["text"].split(" ") if kept else []
        for at in range(0, len(words) - 29, 30):
            texts.append(" ".join(words[at : at + 30]))
            languages.append(r["lang"])
    got = quality.judge(pa.array(texts), languages, encoder)
    judged = [k for k, failed in zip(got["kept"].tolist(), got["base_failed"].tolist(), strict=True) if not failed]
    assert len(judged) > 1000
    assert sum(judged) >= 0.98 * len(judged)


def test_short_good_documents_pass_the_stage(spark):
    """Of 55, 210 and 313 tokens; all three were dropped."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IN (764, 776, 940)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == [764, 776, 940]


def test_limits_widen_below_full_only():
    band = quality.Band((2.0, 3.0), full=800)
    assert band.limits(800) == band.limits(10**6) == (2.0, 3.0)
    assert band.limits(200) == (1.5, 3.5)
    assert band.limits(0)[0] < band.limits(1)[1]
    assert quality.Band((2.0, 3.0)).limits(1) == (2.0, 3.0)
