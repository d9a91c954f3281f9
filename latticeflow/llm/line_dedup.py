"""Removal of repeated line runs, by a suffix array over line ids.

All lines with a word, in the order (document, line), are one sequence; a document's end cuts it. Lines that occur
once can't be in a repeated run and cut it too. Prefix doubling then ranks the first 1, 2, 4, ... lines of each
suffix: a round joins a suffix's rank with the rank 2^k lines on, and the distinct pairs are sorted by ranges; their
order is the next rank. A suffix that nobody shares is in an interval of its own and leaves. Suffixes in the order of the
last rank are the suffix array; the suffixes that agree on n lines are one of its longest-common-prefix intervals, and
the ranks of 2^k lines at its head and at its tail, which overlap, say which. For each line, the shortest run from it
and the shortest run up to it with ``min_words`` words are looked up. An interval's first position is its first copy;
the runs at all others are later copies. A maximal repeated run is the union of such runs, so all its lines go in its
later copies. As a line has a word, runs have at most ``min_words`` lines, and ``log2(min_words)`` rounds suffice for any
input; an array over longer prefixes would part no interval that matters here.

Copies overlap where a run repeats at once (a line ten times in a row): its first position stays, the others go.

Defined results: a null text has no lines and stays null; a text is kept with the lines that remain, which may be
none (then it is empty); lines without a word are no part of runs and stay; null ids sort first; equal rows (id
and text) count as one document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._common import Scratch, cut, documents, free_name, map_batches, map_rows

#: A run with as many words is removed where it comes again.
MIN_WORDS = 50
#: Lines that a worker hashes and returns at once: short lines take many times their bytes as rows.
MOST_LINES = 1 << 14


def _n_words(lines: pa.Array) -> np.ndarray:
    parts = pc.ascii_split_whitespace(lines)
    cuts = parts.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(parts.flatten(), "").to_numpy(zero_copy_only=False)
    total = np.concatenate((np.zeros(1, np.int32), np.cumsum(real, dtype=np.int32)))
    return total[cuts[1:] - cuts[0]] - total[cuts[:-1] - cuts[0]]


def _doc_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with a word: the document (id and text digest), line number, count before it, hash and words."""
    rows = documents(docs, id_col=id_col, text_col=text_col)

    def make():
        def work(batch):
            texts = pc.fill_null(batch.column("text"), "")
            text = pa.array([xxhash.xxh3_128_digest(x) for x in texts.to_pylist()], pa.binary())
            lists = pc.split_pattern(texts, "\n")
            lines = lists.flatten()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            words = np.concatenate([_n_words(lines.slice(at, MOST_LINES)) for at in range(0, len(lines), MOST_LINES)])
            before = np.concatenate((np.zeros(1, np.int32), np.cumsum(words > 0, dtype=np.int32)))
            every = np.flatnonzero(words)
            for at in range(0, len(every), MOST_LINES):
                held = every[at : at + MOST_LINES]
                own = np.searchsorted(bounds, held, "right") - 1  # any text has a line
                row = pa.array(own)
                yield {
                    "doc_id": batch.column("doc_id").take(row),
                    "text_key": text.take(row),
                    "line": (held - bounds[own]).astype(np.int32),
                    "seq": (before[held] - before[bounds[own]]).astype(np.int32),
                    "hash": [xxhash.xxh3_128_digest(x) for x in lines.take(pa.array(held)).to_pylist()],
                    "words": words[held],
                }

        return work

    return map_rows(rows, "doc_id long, text_key binary, line int, seq int, hash binary, words int", make)


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch, table: str) -> DataFrame:
    """``rows`` with ``rank``: the place of its keys in the order of all that come twice or more; those alone are left out.

    Ranks have gaps: a range's number and the place in it are one number, so that no task sees all.
    """
    shared = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").select(*keys)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return rows.join(scratch.put(ordered.withColumn("rank", F.monotonically_increasing_id()), f"{table}-ranks"), keys)


def _doc() -> Column:
    return F.struct(F.col("doc_id"), F.col("text_key")).alias("doc")


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``text_key`` and the numbers of the lines (``lines``, from 0) that go from each document that loses any."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    every = scratch.put(_doc_lines(docs, id_col, text_col), "lines")
    counted = scratch.put(every.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1").select("hash"), "repeated")
    active = scratch.put(every.join(counted, "hash").select(_doc(), "seq", "line", "words", "hash").dropDuplicates(["doc", "seq"]), "active")
    scratch.drop("lines", "repeated")
    ranks = {0: scratch.put(_ranked(active.select("doc", "seq", "hash"), ["hash"], scratch, "rank0").select("doc", "seq", "rank"), "rank0")}
    k = 0
    while 1 << (k + 1) <= min_words:
        now = ranks[k]
        ahead = now.select("doc", (F.col("seq") - (1 << k)).alias("seq"), F.col("rank").alias("next"))
        pairs = scratch.put(now.join(ahead, ["doc", "seq"]), f"pairs{k + 1}")
        k += 1
        table = _ranked(pairs.withColumnRenamed("rank", "here"), ["here", "next"], scratch, f"rank{k}")
        ranks[k] = scratch.put(table.select("doc", "seq", "rank"), f"rank{k}")
        scratch.drop(f"pairs{k}", f"rank{k}-ranks")
    windows = scratch.put(_windows(active, min_words), "windows")
    runs = None
    for level, ranked in ranks.items():
        size = 1 << level
        own = windows.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        head = own.join(ranked.select("doc", F.col("seq").alias("start"), F.col("rank").alias("head")), ["doc", "start"])
        tail = ranked.select("doc", (F.col("seq") + size).alias("stop"), F.col("rank").alias("tail"))
        both = head.withColumn("stop", F.col("start") + F.col("n")).join(tail, ["doc", "stop"]).select("doc", "start", "n", "head", "tail")
        runs = both if runs is None else runs.union(both)
    runs = scratch.put(runs, "runs")  # n says of which level the ranks are
    scratch.drop("windows", *(f"rank{x}" for x in ranks))
    first = scratch.put(runs.groupBy("n", "head", "tail").agg(F.min(F.struct("doc", "start")).alias("first")), "intervals")
    gone = runs.join(first, ["n", "head", "tail"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "n")
    taken = gone.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("seq")).distinct()
    return taken.join(active.select("doc", "seq", "line"), ["doc", "seq"]).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines")).select("doc.doc_id", "doc.text_key", "lines")


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """For each active line, the shortest run of active lines from it and the shortest one up to it with ``min_words`` words.

    A document's lines come together for this; they are a part of one document.
    """
    lists = active.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "words"))).alias("own"))

    def make():
        def work(batch):
            own = batch.column("own")
            bounds = own.offsets.to_numpy().astype(np.int64)
            flat = own.flatten()
            bounds -= bounds[0]
            seq, words = (flat.field(x).to_numpy().astype(np.int64) for x in ("seq", "words"))
            doc = np.repeat(np.arange(len(own)), np.diff(bounds))
            if not len(seq):
                return
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1] + 1)]  # where a stretch of active lines begins
            stretch = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            last = np.r_[first[1:], len(seq)]
            total = np.concatenate(([0], np.cumsum(words)))
            at = np.arange(len(seq))
            stop = np.searchsorted(total, total[:-1] + min_words, "left")  # total[stop] - total[at] >= min_words
            fits = stop <= last[stretch]
            begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
            back = begin >= first[stretch]
            starts, n = np.concatenate([at[fits], begin[back]]), np.concatenate([(stop - at)[fits], (at + 1 - begin)[back]])
            starts, n = np.unique(np.stack([starts, n]), axis=1) if len(starts) else (starts, n)
            yield {"doc": batch.column("doc").take(pa.array(doc[starts])), "start": seq[starts].astype(np.int32), "n": n.astype(np.int32)}

        return work

    return map_rows(lists, "doc struct<doc_id: bigint, text_key: binary>, start int, n int", make)


def remove_repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with the text that remains; with ``removed``, a column of that name holds the numbers of the lines that went."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.put(repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col, scratch=scratch), "gone")
    key, own, lines = (free_name(docs, x) for x in ("own_key", "own_id", "gone_lines"))

    def digest(batches):
        for batch in (part for whole in batches for part in cut(whole)):
            text = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.append_column(key, pa.array([xxhash.xxh3_128_digest(x or "") for x in text], pa.binary()))

    keyed = map_batches(docs, digest, _with(docs, key)).withColumn(own, F.col(id_col).cast("long"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.col("lines").alias(lines))
    # texts are shuffled at any size, so that the cost of small inputs says what large ones take
    marked = keyed.join(gone.hint("merge"), keyed[own].eqNullSafe(gone["gone_id"]) & (keyed[key] == gone["gone_key"]), "left")
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(split, lambda _, k: ~F.array_contains(F.col(lines), k))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = marked.withColumn(text_col, text)
    return out.select(*docs.columns, *([F.coalesce(F.col(lines), F.array().cast("array<int>")).alias(removed)] if removed else []))


def _with(docs: DataFrame, key: str) -> StructType:
    return StructType([*docs.schema.fields, StructField(key, BinaryType())])
