"""Links between texts whose sets of word shingles resemble each other: MinHash bands, then the exact Jaccard.

A text's shingles are hashed once; a band is a hash of the least values of ``ROWS`` permutations of them. Two texts
with Jaccard ``j`` share none of the ``BANDS`` bands with probability ``(1 - j ** ROWS) ** BANDS``: 5e-6 at 0.8,
which is the least similarity that is taken. Texts that share a band are compared on their whole sets, so what is
linked is exact.

Distinct texts that share a band meet in its cell, and cells that share a text belong to one unit; a unit with over
``UNIT`` texts falls into its cells, each a unit then. A unit's sets are shuffled once, or, where they have more than
``BLOCK`` texts or ``BLOCK_BYTES``, in blocks, each of which meets each other one in a task of its own. A task counts the
shingles that its texts share, two matrices of a block at a time, and returns a spanning forest of the links, so nothing
grows with the square of a unit but the number of comparisons. Only texts that share a cell with another have their sets
made and moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, cut, map_batches, map_rows, struct_of
from .components import components, forest
from .words import coded_words, shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Hashes that are permuted at a time, and rows of cells in a task.
CHUNK, TASK_ROWS = 1 << 15, 400_000
#: Texts of a unit that isn't split into its cells, and texts and bytes of sets in a block.
UNIT, BLOCK, BLOCK_BYTES = 20_000, 1024, 8 << 20
#: Shingles that so many texts of a task have are counted by matrices, and so many of them at a time.
DENSE, COLUMNS = 48, 1024
#: Bits of the filter that says which texts can be in a cell with others.
FILTER = 1 << 23
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and where each text's begin and end.

    Words are parted by white space and lower-cased in ASCII, as in the fingerprints; all words of a shorter text
    are its one shingle, and a text without words has none.
    """
    distinct, word, bounds = coded_words(pc.ascii_lower(texts))
    hashes = word_hashes(distinct)[word]
    n = np.diff(bounds)
    counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    own = np.repeat(np.arange(len(n)), counts)
    at = bounds[own] + np.arange(len(own)) - out[own]
    whole = shingle_hashes(hashes, size)
    found = whole[np.minimum(at, len(whole) - 1)] if len(whole) else np.zeros(len(at), np.uint64)
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        found[out[k]] = shingle_hashes(hashes[bounds[k] : bounds[k + 1]], int(n[k]))[0]
    return found, out


def bands_of(texts: pa.Array, size: int = SHINGLE) -> pa.ListArray:
    """The bands of each text; none without words."""
    hashed, bounds = shingles_of(texts, size)
    held = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(held), BANDS), np.uint64)
    for part in np.split(np.arange(len(held)), np.flatnonzero(np.diff(bounds[held] // CHUNK)) + 1):
        if not len(part):
            continue
        first = bounds[held[part[0]]]
        own, starts = hashed[first : bounds[held[part[-1]] + 1]], bounds[held[part]] - first
        for k in range(BANDS):
            x = np.full(len(part), k, np.uint64)
            for factor in _FACTORS[k * ROWS : (k + 1) * ROWS]:
                x = (x ^ np.minimum.reduceat(own * factor, starts)) * _MIX
                x ^= x >> np.uint64(32)
            out[part, k] = x
    offsets = np.concatenate(([0], np.cumsum(np.diff(bounds) > 0))) * BANDS
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.reshape(-1).view(np.int64)))


def _shared(cells: DataFrame, rows: int) -> DataFrame:
    """``cell``, ``key`` and ``least`` (the cell's least key) of the cells in which distinct texts meet."""
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(x).to_numpy() for x in ("cell", "key")] for b in batches]
        cell, key = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        order = np.lexsort((key, cell))
        cell, key = cell[order], key[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        size = np.diff(np.r_[starts, len(cell)])
        held, least = np.repeat(size > 1, size), np.repeat(key[starts], size)
        yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (cell, key, least)], names=["cell", "key", "least"])

    return map_batches(cells.repartition(tasks, "cell"), run, struct_of("cell long, key long, least long"))


def _units(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """``unit`` and ``key``: the texts that are compared with each other."""
    edges = shared.select(F.col("key").alias("a"), F.col("least").alias("b"))
    whole = scratch.put(components(edges, scratch), "whole")
    sizes = scratch.put(whole.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > UNIT).select("root"), "large")
    small = whole.join(sizes, "root", "left_anti").select(F.col("root").alias("unit"), F.col("node").alias("key"))
    if sizes.isEmpty():
        return small
    large = whole.join(sizes, "root").select(F.col("node").alias("key"))
    return small.union(shared.join(large, "key", "left_semi").select(F.col("cell").alias("unit"), "key"))


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each hash that a key has, as 64-bit words: ``FILTER`` bits come to the driver at most."""
    at = F.pmod("key", F.lit(FILTER))
    words = keys.groupBy((at / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(texts: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """``key``, the number of shingles ``n`` and the ``shingles`` of the texts with one of the keys, and of few others."""
    sent = texts.sparkSession.sparkContext.broadcast(_filter(keys))

    def make():
        bits = sent.value

        def work(batch):
            at = batch.column("key").to_numpy().view(np.uint64) % np.uint64(FILTER)
            held = batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for part in cut(held):
                hashed, bounds = shingles_of(part.column("text"), size)
                own = [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield {"key": part.column("key"), "n": np.array([len(x) for x in own], np.int64), "shingles": [x.tobytes() for x in own]}

        return work

    return map_rows(texts, "key long, n long, shingles binary", make).dropDuplicates(["key"])


def _in_blocks(units: DataFrame, sets: DataFrame) -> DataFrame:
    """``unit``, ``i``, ``j`` (blocks of it that meet), ``key`` and ``root`` of each text, once for each block that it meets."""
    sized = units.join(sets.select("key", "n"), "key")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    several = sized.groupBy("unit").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("key", "unit"), F.col("blocks")).cast("int")
    placed = units.join(several, "unit").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets (of distinct values) share."""
    n = len(sets)
    value, own = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, own = value[order], own[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    size = np.diff(np.r_[starts, len(value)])
    counts = np.zeros((n, n), np.float32)  # whole numbers up to 2 ** 24
    dense = np.flatnonzero(size >= DENSE)
    for at in range(0, len(dense), COLUMNS):
        part = dense[at : at + COLUMNS]
        held = np.zeros((n, len(part)), np.float32)
        for k, v in enumerate(part.tolist()):
            held[own[starts[v] : starts[v] + size[v]], k] = 1
        counts += held @ held.T
    rare = np.repeat((size > 1) & (size < DENSE), size)
    end = np.repeat(starts + size, size)
    index, shift = np.flatnonzero(rare), 1
    while len(index := index[index + shift < end[index]]):
        pair = own[index] * n + own[index + shift]  # a set comes once, and sets in order
        counts += np.bincount(pair, minlength=n * n).reshape(n, n) if len(pair) > n * n // 8 else _scattered(pair, n)
        shift += 1
    return np.maximum(counts, counts.T)


def _scattered(pair: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n * n, np.float32)
    np.add.at(out, pair, 1)
    return out.reshape(n, n)


def near_edges(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, over the roots, of the links between sets with that Jaccard."""
    size = np.array([len(x) for x in sets], np.float64)
    counts = shared_counts(sets).astype(np.float64)
    np.fill_diagonal(counts, 0)
    i, j = np.nonzero(counts >= similarity * (size[:, None] + size[None, :] - counts) - 1e-9)
    held = (i < j) & (root[i] != root[j])
    nodes, at = np.unique(root, return_inverse=True)
    label = forest(at[i[held]], at[j[held]], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` between roots: ``rows`` has ``unit``, ``i``, ``j``, ``root`` and ``shingles``."""
    group = ["unit", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, sets = None, [], []

        def done() -> pa.RecordBatch:
            several = len(set(root)) > 1
            a, b = near_edges(np.array(root, np.int64), sets, similarity) if several else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            places = zip(*(batch.column(x).to_pylist() for x in group), strict=True)
            for place, own, held in zip(places, batch.column("root").to_pylist(), batch.column("shingles"), strict=True):
                if place != now:
                    yield done()
                    now, root, sets = place, [], []
                root.append(own)
                sets.append(np.frombuffer(held.as_buffer(), np.uint64).copy())
        yield done()

    return map_batches(rows.repartition(*group).sortWithinPartitions(*group), run, struct_of("a long, b long")).distinct()


def link(members: DataFrame, rows: DataFrame, texts: DataFrame, *, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """``members`` (``node``, ``root``) with the components that the links between resembling texts join.

    ``rows`` has ``key`` (of the text), ``fp`` (the text's node) and ``bands``; ``texts`` has ``key`` and ``text``.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the bands find texts with a similarity of {SIMILARITY} at least")
    scratch = Scratch(rows.sparkSession, "resemblance")
    distinct = rows.where(F.size("bands") > 0).dropDuplicates(["key"])
    shared = scratch.put(_shared(distinct.select("key", F.explode("bands").alias("cell")), BANDS * rows.count()), "shared")
    units = scratch.put(_units(shared, scratch), "units")
    keys = scratch.put(units.select("key").distinct(), "keys")
    own = rows.select("key", "fp").join(keys, "key", "left_semi").distinct()
    rooted = scratch.put(own.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root")), "rooted")
    sets = scratch.put(_sets(texts, keys, size), "sets")
    scratch.drop("shared", "whole", "keys")
    placed = _in_blocks(units, sets).join(sets.join(rooted, "key").select("key", "root", "shingles"), "key")
    edges = scratch.put(_compared(placed, similarity), "links")
    scratch.drop("sets")
    tops = scratch.put(components(edges, scratch), "tops").select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = tops.join(members.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return members.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(lone)
