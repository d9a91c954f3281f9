"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become ids and an end id; those over the capacity are cut into full pieces and a rest. Best-fit
decreasing then runs on the counts of lengths (at most ``capacity`` of them), not on pieces: it yields runs "the
pieces of this length with ranks r to r + n take this place in sequences s to s + n". Pieces get their rank within
their length, frequent lengths being ranked in parts, and look their place up in the runs.

What comes to the driver is bounded: ``capacity`` counts, ``capacity + PARTS`` counts of parts, and the runs.

Defined results: a null text is empty, and an empty text is one piece that holds the end id alone; null ids and
repeated rows are packed like any other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Scratch, documents, map_rows
from .vocab import ModelFile

#: Ranked together are this many pieces of one length, or more where there would be over PARTS such parts.
PART, PARTS = 400, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Runs of best-fit decreasing: rows (length, first rank, pieces, first sequence, offset), by length and rank.

    All pieces of one length fit equally well, so each class of sequences with the same space left is filled at
    once: the fullest class that the length fits takes as many pieces in a sequence as it holds.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # space left: sequences (first, how many)
    left: list[int] = []  # its keys, in order
    runs, sequences = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room not in space:
            insort(left, room)
            space[room] = []
        space[room].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            k = bisect_left(left, length)
            if k < len(left):
                room = left[k]
                first, n = space[room].pop()
                if not space[room]:
                    del space[room], left[k]
            else:
                room, first, n = capacity, sequences, -(-todo // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, todo // each)
            for j in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - room + j * length))
                rank += full
            todo -= full * each
            if full:
                add(room - each * length, first, full)
            if full < n and todo < each:  # the last, partly filled one, and those not needed
                for j in range(todo):
                    runs.append((length, rank, 1, first + full, capacity - room + j * length))
                    rank += 1
                if todo:
                    add(room - todo * length, first + full, 1)
                    full += 1
                todo = 0
            if full < n:
                add(room, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, model: ModelFile, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with the CRC-32 of their ids (little-endian, 32 bits each)."""

    def make():
        encoder = model.load()
        tail = np.array([end_id], "<u4").tobytes()

        def work(batch):
            ids, offsets = encoder.encode_all(pc.fill_null(batch.column("text"), ""))
            raw, bounds = memoryview(ids.astype("<u4", copy=False).tobytes()), offsets.tolist()
            n = np.diff(offsets) + 1
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            crc = []
            for r, s, size, last in zip(row.tolist(), start.tolist(), length.tolist(), (start + length == n[row]).tolist(), strict=True):
                at = bounds[r] + s
                value = zlib.crc32(raw[4 * at : 4 * (at + size - last)])
                crc.append(zlib.crc32(tail, value) if last else value)
            yield {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)}

        return work

    return map_rows(documents(docs, id_col=id_col, text_col=text_col), PIECES, make)


def pack(docs: DataFrame, model: ModelFile, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; in a sequence the places join without gaps from 0."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.put(pieces(docs, model, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = plan(counts, capacity)
    part = max(PART, -(-sum(counts.values()) // PARTS))
    parts = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        parts[length] = -(-n // part)
    first = np.cumsum(parts) - parts
    hot = F.create_map(*[F.lit(int(x)) for k in np.flatnonzero(parts > 1) for x in (k, parts[k])]) if (parts > 1).any() else None
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(hot[F.col("length").cast("int")], F.lit(1))) if hot is not None else F.lit(0)
    salted = cut.withColumn("salt", salt.cast("long"))
    base = np.zeros(int(parts.sum()) + 1, np.int64)
    for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect():  # <= capacity + PARTS rows
        base[first[r["length"]] + r["salt"]] = r["n"]
    for k in np.flatnonzero(parts > 1):
        own = base[first[k] : first[k] + parts[k]]
        base[first[k] : first[k] + parts[k]] = np.cumsum(own) - own
    base[first[parts == 1]] = 0
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("rank", F.row_number().over(order))
    shift = 1 << 44
    keys = runs[:, 0] * shift + runs[:, 1]

    def make():
        def work(batch):
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank.astype(np.int64) - 1 + base[first[length] + salt]
            run = runs[np.searchsorted(keys, length * shift + rank, "right") - 1]
            yield {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": run[:, 3] + rank - run[:, 1], "offset": run[:, 4]}

        return work

    return map_rows(ranked, f"{PIECES}, sequence_id long, offset long", make)
