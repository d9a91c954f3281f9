"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 3-grams of the lower-cased letters of a whole text, with every other sign as a space, hashed
into ``BUCKETS`` buckets. The model is a matrix of log-probabilities (languages by buckets), fitted on the labelled
rows that aren't held out and broadcast; its size doesn't depend on the corpus: over ``LANGUAGES`` languages are
refused. A batch of texts is scored as one sparse product: the matrix's columns of all n-grams, summed by text.

Fitted is on a bounded sample: about ``SAMPLE`` rows of each language (all rows of a rarer one), chosen by a hash of
the id. Held out are the rows with ``crc32(doc_id) mod 4 = 2``.

Defined results: texts that are null or have no letter are ``und`` with score 0, as all are where nothing is
labelled; equal scores go to the first language in code order; rows with a null id are held out; repeated rows
count as often as they come; an empty table gives an empty result; other columns are ignored. A label column with over
``LANGUAGES`` values isn't one of languages, and ``fit`` raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents, map_rows

BUCKETS = 1 << 16
SAMPLE = 4000
#: With so many languages the matrix has 67 MB.
LANGUAGES = 128
#: Text taken at once; the arrays of its n-grams take some fifty times as much.
PART_BYTES = 1 << 20
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: A column for each bucket, and a last one of zeros for what isn't an n-gram.
    logs: np.ndarray
    priors: np.ndarray

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and its posterior for texts without nulls."""
        grams, bounds, letters = features(texts)
        known = letters > 0
        if not self.languages or not known.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.empty((len(self.languages), len(texts)))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        for k, own in enumerate(self.logs):
            total[k] = self.priors[k]
            for order in grams:
                total[k, full] += np.add.reduceat(own[order], bounds[:-1][full])
        best = total.argmax(0)
        score = 1 / np.exp(total - total.max(0)).sum(0)
        return [self.languages[b] if x else "und" for b, x in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The buckets of the n-grams of each order at each character (``BUCKETS`` for none), the texts' bounds, and their letters."""
    lower = pc.utf8_lower(texts)
    if lower.offset:
        lower = pa.concat_arrays([lower])
    _, offsets, data = lower.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(lower) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[: ends[-1]]
    bounds = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))[ends]
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    counted = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
    sign = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    n = len(code)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # characters from here to the text's end
    out = []
    for size in (1, 2, 3):
        gram = np.full(n, BUCKETS, np.int32)
        if n >= size:
            mixed = np.full(n - size + 1, size * 0x27D4EB2F, np.uint64)
            for k in range(size):
                mixed = (mixed ^ sign[k : n - size + 1 + k]) * np.uint64(_ODD[k])
                mixed ^= mixed >> np.uint64(15)
            real = letter[size // 2 : n - size + 1 + size // 2] & (left[: n - size + 1] >= size)
            gram[: n - size + 1] = np.where(real, (mixed & np.uint64(BUCKETS - 1)).astype(np.int32), BUCKETS)
        out.append(gram)
    return out, bounds, counted[bounds[1:]] - counted[bounds[:-1]]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def fit(docs: DataFrame, *, sample: int = SAMPLE, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of the labelled rows that aren't held out; to the driver come its languages times ``BUCKETS`` counts."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"the label column has over {LANGUAGES} values")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS + 1)), np.zeros(0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / counts[k])))])
    chosen = documents(rows, F.col(lang_col).cast("string").alias("lang"), id_col=id_col, text_col=text_col)
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in cut(whole, PART_BYTES)):
            lang = np.array(batch.column("lang").to_pylist(), object)
            for language in set(lang.tolist()):
                own = batch.column("text").filter(pa.array(lang == language))
                total = found.setdefault(language, np.zeros(BUCKETS + 1, np.int64))
                for order in features(own)[0]:
                    total += np.bincount(order, minlength=BUCKETS + 1)
        for language, total in found.items():
            bucket = np.flatnonzero(total[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], names=["lang", "bucket", "n"])

    summed = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((len(languages), BUCKETS))
    at = {x: k for k, x in enumerate(languages)}
    matrix[[at[x] for x in summed["lang"].to_pylist()], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    matrix += smoothing
    logs = np.log(matrix) - np.log(matrix.sum(1, keepdims=True))
    total = sum(counts.values())
    return LanguageModel(languages, np.hstack([logs, np.zeros((len(languages), 1))]), np.log([counts[x] / total for x in languages]))


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row; from the text alone."""
    rows = documents(docs, held_out(id_col).alias("held_out"), id_col=id_col, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = sent.value

        def work(batch):
            lang, score = fitted.score(pc.fill_null(batch.column("text"), ""))
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

        return work

    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", make, PART_BYTES)
