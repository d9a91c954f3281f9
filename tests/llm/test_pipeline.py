"""The pipeline against plain versions of its stages, in turn."""

from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
import corpus_pipeline  # noqa: E402
from latticeflow.llm import quality, queries  # noqa: E402

from .test_groups import plain_components, plain_fingerprint, plain_repeated  # noqa: E402
from .test_rows import check_packing  # noqa: E402
from .test_search import plain_leaks  # noqa: E402


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    verdict = quality.judge(pa.array([r["text"] or "" for r in rows]), [r["lang"] for r in rows], queries.piece_model().load())["kept"]
    rows = [r for r, k in zip(rows, verdict, strict=True) if k]
    gone = plain_repeated(rows, 50)
    for r in rows:
        own = gone[r["doc_id"], r["text"]]
        if own:
            r["text"] = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in own)
            r["n_chars"] = len(r["text"])
    rows.sort(key=lambda r: r["doc_id"])
    fp = [plain_fingerprint(r["text"]) for r in rows]
    root = plain_components(len(rows), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    leaks = plain_leaks([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [r for r in rows if not any(r["doc_id"] == d for d, *_ in leaks)]
    found, stages = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf)
        assert found.columns == docs.columns, name
        stages.append(found)
    assert Counter(tuple(r.asDict().items()) for r in found.collect()) == Counter(tuple(r.items()) for r in rows)
    check_packing(corpus_pipeline.run(spark, sf).collect(), rows, 2048)
