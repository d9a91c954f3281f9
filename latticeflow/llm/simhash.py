"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits; the bit counts of the segments are a point in a grid.
Flipping a bit moves the point by one, so the Manhattan distance of two points is at most the Hamming distance of
the fingerprints. Of two fingerprints within three bits, one half of the point (16 segments) is within one step;
so each distinct fingerprint is put into its own cell of either half and into the cells one step away, and meets
there the fingerprints whose own cell it is. Within a cell the other half's four quarters are compared the same way: at
up to three bits one of them has the same counts. Hamming distances are then computed exactly, nothing is missed. (The
Manhattan distance of whole points would bound them from below, but costs as much as they do.)

A cell that is the own one of over ``CELL`` fingerprints is dealt to several tasks: each has a part of these, and all that
visit the cell.

Equal fingerprints are one node from the start. A task returns a spanning forest of the links that it finds, never
the links themselves, so what a group of copies yields grows with its size and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from ._common import Scratch, documents, free_name, map_rows
from .components import components, forest

BITS = 3
HALF, SEGMENTS = 32, 16
#: Rows of the grid in a task, rows of a cell that are compared at a time, and its own fingerprints in a task.
TASK_ROWS, CROWD, CELL = 400_000, 1024, 20_000
_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POWERS = 3 ** np.arange(SEGMENTS, dtype=np.int64)
#: The counts of the four segments of a byte, as one number.
_COUNTS = (_BYTE.reshape(256, 4, 2).sum(2) @ 3 ** np.arange(4)).astype(np.uint8)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit k is set if it is set in over half of the XXH64 of the word shingles; 0 without words."""
    words = text.encode().lower().split()
    if len(words) < shingle:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    if not len(h):
        return 0
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) > 300:
        counts = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BYTE for k in range(8)])
    else:
        counts = np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, bands: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (of the text) and ``fp`` (as a signed long) of each row; with ``bands``, those of its five-word shingles."""
    rows = documents(docs, F.xxhash64(F.col(text_col).cast("string")).alias("key"), id_col=id_col, text_col=text_col)

    def make():
        def work(batch):
            found = np.array([fingerprint(x or "", shingle) for x in batch.column("text").to_pylist()], np.uint64)
            more = {"bands": resemblance.bands_of(pc.fill_null(batch.column("text"), ""))} if bands else {}
            yield {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": found.view(np.int64), **more}

        return work

    return map_rows(rows, "doc_id long, key long, fp long" + (", bands array<long>" if bands else ""), make)


def _grid(fps: DataFrame, *, steps: bool = True) -> DataFrame:
    """A row for each fingerprint's own cell in either half (``own``) and, with ``steps``, for each cell one step away."""

    def make():
        def work(batch):
            signed = batch.column("fp").to_numpy()
            fp = signed.view(np.uint64)
            pairs = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))  # bit counts of the 32 segments
            counts = ((pairs[:, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)).astype(np.int64)
            for half in range(2):
                point = counts[:, half * SEGMENTS : (half + 1) * SEGMENTS]
                cell = (point @ _POWERS) * 2 + half
                yield {"cell": cell, "fp": signed, "own": np.ones(len(cell), bool)}
                for step in (-1, 1) if steps else ():
                    row, k = np.nonzero((point + step >= 0) & (point + step <= 2))
                    yield {"cell": cell[row] + 2 * step * _POWERS[k], "fp": signed[row], "own": np.zeros(len(row), bool)}

        return work

    return map_rows(fps, "cell long, fp long, own boolean", make)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _links_of_crowd(fp: np.ndarray, half: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one crowded cell: of the other half's four bytes one has the same counts at up to three bits."""
    other = (fp >> np.uint64(0 if half else HALF)) & np.uint64(0xFFFFFFFF)
    for k in range(4):
        counts = _COUNTS[(other >> np.uint64(8 * k)) & np.uint64(255)]
        order = np.argsort(counts, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(counts[order])) + 1):
            for at in range(0, len(part), CROWD):
                rows = part[at : at + CROWD]
                for to in range(at, len(part), CROWD):
                    cols = part[to : to + CROWD]
                    x, y = np.nonzero(_near(fp[rows][:, None], fp[cols][None, :], bits))
                    less = rows[x] < cols[y]
                    yield rows[x][less], cols[y][less]


def cell_links(cell: np.ndarray, fp: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of fingerprints) of the links within the cells of one task."""
    order = np.argsort(cell, kind="stable")
    cell, fp, own = cell[order], fp[order], own[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    size = np.diff(np.r_[starts, len(cell)])
    useful = (size > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0) if len(starts) else np.zeros(0, bool)
    held = np.repeat(useful, size)
    cell, fp, own, size = cell[held], fp[held], own[held], size[useful]
    starts = np.cumsum(size) - size
    own_fp, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(own_fp))
    found_i, found_j, waiting = [], [], 0

    def reduce() -> None:
        nonlocal label, found_i, found_j, waiting
        if found_i:
            label = forest(np.concatenate([label, *found_i]), np.concatenate([np.arange(len(label)), *found_j]), len(label))
        found_i, found_j, waiting = [], [], 0

    small = size <= CROWD
    index = np.flatnonzero(np.repeat(small, size))
    end = np.repeat(starts + size, size)[index]
    shift = 1
    while len(index):
        live = index + shift < end
        index, end = index[live], end[live]
        hit = index[_near(fp[index], fp[index + shift], bits) & (own[index] | own[index + shift])]
        found_i.append(node[hit])
        found_j.append(node[hit + shift])
        waiting += len(hit)
        if waiting > 2_000_000:
            reduce()
        shift += 1
    for s, n in zip(starts[~small].tolist(), size[~small].tolist(), strict=True):
        for x, y in _links_of_crowd(fp[s : s + n], int(cell[s] & 1), bits):
            found_i.append(node[s + x])
            found_j.append(node[s + y])
            waiting += len(x)
            if waiting > 2_000_000:
                reduce()
    reduce()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return own_fp[moved], own_fp[label[moved]]


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``), with the components of all links within ``bits``."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the grid finds links of up to {BITS} bits")
    session = fps.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 50 * fps.count() // TASK_ROWS)
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("cell").to_numpy(), b.column("fp").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            cell, fp, own = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b = cell_links(cell, fp.view(np.uint64), own, bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    hot = Scratch(session, "cells").put(_grid(fps, steps=False).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "hot")
    grid = _grid(fps)
    if not hot.isEmpty():
        parts = F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")
        dealt = grid.join(hot, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        # the name of a part keeps the cell's half; parts that share one do no harm, as all links are tested
        name = F.when(F.col("n").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "part").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("cell").bitwiseAND(F.lit(1))))
        grid = dealt.select(name.alias("cell"), "fp", (F.col("own") & (F.pmod(F.xxhash64("fp"), parts) == F.col("part"))).alias("own"))
    return grid.repartition(tasks, "cell").mapInArrow(run, schema)


def _classes(docs: DataFrame, scratch: Scratch, bits: int, shingle: int, id_col: str, text_col: str, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows' fingerprints, and for each distinct one the least row of its component: its id (nulls last) and key."""
    rows = scratch.put(fingerprints(docs, shingle=shingle, bands=similarity is not None, id_col=id_col, text_col=text_col), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least")
    classes = scratch.put(rows.groupBy("fp").agg(least), "classes")
    members = components(scratch.put(links(classes.select("fp"), bits), "links"), scratch)
    if similarity is not None:
        texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
        members = scratch.put(resemblance.link(members, rows, texts, similarity=similarity), "resembling")
    members = scratch.put(members.join(classes, members["node"] == classes["fp"]).select("fp", "root", "least"), "members")
    roots = scratch.put(members.groupBy("root").agg(F.min("least").alias("best")), "roots")
    linked = scratch.put(members.join(roots, "root").select("fp", "best"), "linked")
    return rows, scratch.put(classes.join(linked, "fp", "left").select("fp", F.coalesce("best", "least").alias("least")), "labelled")


def near_duplicates(docs: DataFrame, *, bits: int = BITS, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    Defined results: a null text is empty; texts without words share fingerprint zero, which links like any other;
    rows with a null id take part, but ``component_id`` is the smallest id that isn't null (null if there is none);
    repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    rows, labelled = _classes(docs, Scratch(docs.sparkSession, "simhash"), bits, shingle, id_col, text_col)
    return rows.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, bits: int = BITS, shingle: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (nulls last).

    With ``similarity``, texts whose sets of five-word shingles have that Jaccard are linked too. Of rows with one id,
    the text decides; of equal rows one stays.
    """
    _, labelled = _classes(docs, Scratch(docs.sparkSession, "simhash"), bits, shingle, id_col, text_col, similarity)
    id_key = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    own, key = free_name(docs, "own_id"), free_name(docs, "own_key")
    keep = labelled.select(id_key(F.col("least.doc_id")).alias(own), F.col("least.key").alias(key)).distinct()
    keyed = docs.withColumns({own: id_key(F.col(id_col).cast("long")), key: F.xxhash64(F.col(text_col).cast("string"))})
    # both sides and the duplicates go by the same plain columns, so texts are shuffled once
    return keyed.join(keep, [own, key], "left_semi").dropDuplicates([own, key]).drop(own, key)
