"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is its set of five-word shingles. Items are partitioned by size (powers of two); in a partition whose
items have at most u shingles, an item's sketch is the ``floor((1 - t) * u) + 1`` smallest of its shingle hashes.
A document with a share t of an item's shingles lacks fewer than that, so it holds a value of the sketch: the search
misses nothing, however long the document. A document's shingle hashes are looked up among the sketches; what is
found is verified on the words themselves.

The benchmark is a stated query set. It is written in blocks of about ``BLOCK_BYTES``, by a hash of text and id, each
broadcast and run against all documents, so that the broadcast is bounded whatever the benchmark's size.

With ``short``, an item with fewer than five words is one shingle, all its words, and is looked up among the runs of
as many words; without it such items match nothing.

Defined results: words are compared in lower case without ASCII signs; items without a word match nothing; null texts
match nothing; null ids and repeated rows pass through; with an empty benchmark nothing is found; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, cut, documents, map_batches, map_rows
from .words import shingle_hashes, word_hashes, words_of

SHINGLE, CONTAINMENT = 5, 0.8
BLOCK_BYTES = 8 << 20
_BITS = 22


class Sketches:
    """The items of one block: ids, shingles, and the sketch values with the items that have them."""

    def __init__(self, items: list[tuple[int, str]], containment: float, shingle: int = SHINGLE, short: bool = False):
        self.containment, self.shingle = containment, shingle
        distinct, word, bounds = words_of(pa.array([t for _, t in items], pa.string()))
        hashed = shingle_hashes(word_hashes(distinct)[word], shingle)
        self.ids, self.shingles, held = [], [], []
        #: By number of words, the short items with these words.
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for k, (item, _) in enumerate(items):
            own = range(int(bounds[k]), int(bounds[k + 1]) - shingle + 1)
            names = [distinct[w] for w in word[bounds[k] : bounds[k + 1]].tolist()]
            if not own:
                if short and names:
                    self.short.setdefault(len(names), {}).setdefault((*names,), []).append(len(self.ids))
                    self.ids.append(item)
                    self.shingles.append(frozenset([(*names,)]))
                continue
            parts = frozenset(zip(*(names[x:] for x in range(shingle)), strict=False))
            values = np.unique(hashed[own.start : own.stop])
            largest = (1 << len(parts).bit_length()) - 1  # of the item's partition
            held += [(int(v), len(self.ids)) for v in values[: int((1 - containment) * largest + 1e-9) + 1]]
            self.ids.append(item)
            self.shingles.append(parts)
        held.sort()
        self.values = np.array([v for v, _ in held], np.uint64)
        self.items = np.array([k for _, k in held], np.int64)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """Row, item index and shared shingles of each text that contains an item."""
        distinct, word, bounds = words_of(texts)
        hashed = shingle_hashes(word_hashes(distinct)[word], self.shingle)
        at = np.flatnonzero(self.table[(hashed >> np.uint64(64 - _BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.values, hashed[at], "left"), np.searchsorted(self.values, hashed[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        row = np.searchsorted(bounds, at, "right") - 1
        whole = at + self.shingle <= bounds[row + 1]
        candidates = defaultdict(set)
        for r, a, b in zip(row[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True):
            candidates[r].update(self.items[a:b].tolist())
        yield from self._short(distinct, word, bounds)
        for r, items in candidates.items():
            names = [distinct[w] for w in word[bounds[r] : bounds[r + 1]].tolist()]
            own = set(zip(*(names[x:] for x in range(self.shingle)), strict=False))
            for k in sorted(items):
                shared = len(own & self.shingles[k])
                if shared >= self.containment * len(self.shingles[k]) - 1e-9:
                    yield r, k, shared


    def _short(self, distinct: list[str], word: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same of the short items, whose words a text has in a row."""
        at = {w: k for k, w in enumerate(distinct)} if self.short else {}
        for size, items in self.short.items():
            for names, own in items.items():
                codes = [at.get(x, -1) for x in names]
                if min(codes) < 0:
                    continue
                hit = np.flatnonzero(word[: len(word) - size + 1] == codes[0])
                for k in range(1, size):
                    hit = hit[word[hit + k] == codes[k]]
                row = np.searchsorted(bounds, hit, "right") - 1
                for r in np.unique(row[hit + size <= bounds[row + 1]]).tolist():
                    yield from ((r, k, 1) for k in own)


def blocks(benchmark: DataFrame, containment: float, *, short: bool = False, item_col: str = "item_id", text_col: str = "text") -> Iterator[Sketches]:
    """The benchmark's sketches, a block of about ``BLOCK_BYTES`` of text at a time."""
    scratch = Scratch(benchmark.sparkSession, "items")
    items = scratch.put(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK_BYTES)
    if n > 1:  # a block is read alone then
        items = scratch.put(items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(n))), "blocks", by="block")
    for k in range(n):
        rows = (items.where(F.col("block") == k) if n > 1 else items).collect()  # about BLOCK_BYTES
        yield Sketches(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x)), containment, short=short)


def _item_text(benchmark: DataFrame, text_col: str, item_text_col: str | None) -> str:
    return item_text_col or (text_col if text_col in benchmark.columns else "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, containment: float = CONTAINMENT, short: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str | None = None) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared``, ``n_shingles`` and ``containment`` of each row and item found in it.

    The items' text is in ``item_text_col``: by default ``text_col`` if the benchmark has it, else ``text``.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    rows, out = documents(docs, id_col=id_col, text_col=text_col), None
    for block in blocks(benchmark, containment, short=short, item_col=item_col, text_col=_item_text(benchmark, text_col, item_text_col)):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent):
            sketches = sent.value

            def work(batch):
                found = [*sketches.found(pc.fill_null(batch.column("text"), ""))]
                row, item, shared = np.array(found, np.int64).reshape(-1, 3).T
                n = np.array([len(sketches.shingles[k]) for k in item.tolist()], np.int64)
                yield {"doc_id": batch.column("doc_id").take(pa.array(row)), "item_id": pa.array([sketches.ids[k] for k in item.tolist()], pa.int64()), "n_shared": shared, "n_shingles": n, "containment": np.round(shared / np.maximum(n, 1), 6)}

            return work

        part = map_rows(rows, schema, make)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, containment: float = CONTAINMENT, short: bool = False, text_col: str = "text", item_col: str = "item_id", item_text_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    spark = docs.sparkSession
    for block in blocks(benchmark, containment, short=short, item_col=item_col, text_col=_item_text(benchmark, text_col, item_text_col)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for part in cut(batch):
                    text = pc.cast(part.column(part.schema.names.index(text_col)), pa.string())
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, _, _ in sent.value.found(pc.fill_null(text, ""))]] = False
                    yield part.filter(pa.array(clean))

        docs = map_batches(docs, run, docs.schema)
    return docs
