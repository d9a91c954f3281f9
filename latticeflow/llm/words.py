"""Normalised words of a batch of texts, and hashes of their shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: ASCII signs other than letters and digits part words; the bytes of other characters stay.
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with ASCII signs as spaces, for texts without nulls."""
    lower = pc.utf8_lower(texts)
    if lower.offset:
        lower = pa.concat_arrays([lower])
    _, offsets, data = lower.buffers()
    return pa.StringArray.from_buffers(len(lower), offsets, pa.py_buffer(data.to_pybytes().translate(_SIGNS) if data else b""))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct normalised words, each word's index among them, and where each text's words begin and end."""
    return coded_words(normalised(texts))


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same of the words as they are."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    word = coded.indices.to_numpy().astype(np.int64)
    real = np.array([bool(x) for x in distinct], bool)[word] if distinct else np.zeros(0, bool)
    return distinct, word[real], np.concatenate(([0], np.cumsum(real)))[bounds]


def word_hashes(distinct: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct), np.uint64, len(distinct))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words (of all texts as one sequence)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))
