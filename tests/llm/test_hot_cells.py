"""Hot cells and large units, in parts and blocks, against all pairs."""

import numpy as np
import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import resemblance, simhash  # noqa: E402
from latticeflow.llm.components import forest  # noqa: E402

from .test_groups import near_group, plain_components  # noqa: E402
from .test_resemblance import plain_kept, varied  # noqa: E402


@pytest.mark.parametrize("cell", [3, 40])
def test_hot_cells_in_parts(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CROWD", 16)
    fp = near_group(cell, 20, 150, 7)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = forest(i, j, len(fp))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")).collect()
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert (forest(np.array([at[r["a"]] for r in edges]), np.array([at[r["b"]] for r in edges]), len(fp)) == want).all()


@pytest.mark.parametrize("unit, block, dense", [(20_000, 4, 48), (5, 1024, 2), (5, 3, 3), (20_000, 1024, 1000)])
def test_units_in_blocks(spark, monkeypatch, unit, block, dense):
    monkeypatch.setattr(resemblance, "UNIT", unit)
    monkeypatch.setattr(resemblance, "BLOCK", block)
    monkeypatch.setattr(resemblance, "DENSE", dense)
    rows = varied(7 + block)
    want, far = plain_kept(rows)
    assert far > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs, similarity=0.8).collect()) == want


@pytest.mark.parametrize("dense", [2, 5, 1000])
def test_shared_counts(monkeypatch, dense):
    monkeypatch.setattr(resemblance, "DENSE", dense)
    monkeypatch.setattr(resemblance, "COLUMNS", 7)
    rng = np.random.default_rng(dense)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(rng.integers(1, 30))]
        counts = resemblance.shared_counts(sets)
        for a in range(len(sets)):
            for b in range(len(sets)):
                if a != b:
                    assert counts[a, b] == len(np.intersect1d(sets[a], sets[b]))
        root = rng.integers(0, 12, len(sets))
        links = [(a, b) for a in range(len(sets)) for b in range(a) if (n := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
        x, y = resemblance.near_edges(root, sets, 0.8)
        want = plain_components(12, [(int(root[a]), int(root[b])) for a, b in links])
        got = plain_components(12, [*zip(x.tolist(), y.tolist(), strict=True)])
        assert got == want
