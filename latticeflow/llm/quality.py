"""Quality rules: counts of words, symbols, lines and repeats, then tokeniser fertility.

Fertility is how a public vocabulary copes with a text: characters per token, the share of byte-fallback tokens,
and the entropy of the tokens. A band for the text's language, or else for its main script, says what is accepted.

Defined results: a null text has no words and fails the base rules, as an empty one does; a null or unknown
language takes the band of the script, and a text without letters the band ``OTHER``; null ids and repeated rows
pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents, map_batches, map_rows
from .vocab import ModelFile


@dataclass(frozen=True)
class Band:
    """What is accepted. The entropy in bits must reach ``min(entropy_share * log2(tokens), entropy)``.

    Texts of ``least`` tokens and more, that is all but empty ones, are held against all three measures. The limits of
    ``chars_per_token`` are those of texts of ``full`` tokens and more; shorter ones spread more (see ``limits``).
    """

    chars_per_token: tuple[float, float] = (1.2, 9.0)
    byte_share: float = 0.2
    entropy_share: float = 0.7
    entropy: float = 5.0
    least: int = 1
    full: int = 0

    def limits(self, n: int) -> tuple[float, float]:
        """The characters per token accepted of ``n`` tokens: a mean of ``n`` strays from the middle as ``1 / sqrt(n)`` does."""
        low, high = self.chars_per_token
        more = (high - low) / 2 * (math.sqrt(max(self.full / max(n, 1), 1)) - 1)
        return low - more, high + more


#: Fixed value, of the sample below and without labels: the tokens at which a text strays as the whole sample does. That is
#: the square of a ratio, the distance of the quartiles of (characters per token - median) * sqrt(tokens) over that of the
#: characters per token (en 804, de 840, fr 780, es 801). The former distance is 1.75 to 1.83 there and 1.51 to 1.78 in the
#: texts under 256 tokens, so that the root holds for these too.
FULL = 800
#: Fixed values, of a sample and by a rule that know no labels: of the distinct texts of one language in the table of
#: 10,000 documents that have 20 words and 256 tokens at least (4648 en, 1196 de, 1226 fr, 771 es), the quartiles of the
#: characters per token, and from these outwards three times their distance (Tukey's outer fences), to two places.
#: Prose has over six bits a token where it has 300 tokens; signs between all words and repeats lower that.
LANGUAGES: dict[str, Band] = {
    "en": Band((2.40, 2.85), entropy=5.7, full=FULL),
    "de": Band((2.40, 2.84), entropy=5.7, full=FULL),
    "fr": Band((2.12, 2.57), entropy=5.7, full=FULL),
    "es": Band((2.07, 2.50), entropy=5.7, full=FULL),
}
#: Fixed values. Scripts that a vocabulary mostly lacks fall back to bytes, so their share isn't held against them.
SCRIPTS: dict[str, Band] = {
    "Latin": Band((1.5, 8.0)),
    "Cyrillic": Band((0.9, 7.0)),
    "Greek": Band((0.5, 6.0), byte_share=0.6),
    "Han": Band((0.3, 3.0), byte_share=0.9),
    "Hiragana": Band((0.3, 3.0), byte_share=0.9),
    "Hangul": Band((0.3, 3.0), byte_share=0.95),
    "Arabic": Band((0.4, 6.0), byte_share=0.8),
    "Hebrew": Band((0.4, 6.0), byte_share=0.8),
    "Devanagari": Band((0.3, 6.0), byte_share=0.95),
    "Thai": Band((0.3, 6.0), byte_share=0.95),
}
OTHER = Band((0.25, 12.0), byte_share=1.0, entropy_share=0.5, entropy=4.0)

_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in SCRIPTS}
_BEYOND_LATIN = r"[^\x{00}-\x{024F}]"
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"


def script_of(text: str) -> str | None:
    """The script with the most letters; None without letters."""
    counts = {name: len(x.findall(text)) for name, x in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _bounds(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def _symbols(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.diff(np.searchsorted(np.flatnonzero(_SYMBOLS[raw]), offsets - offsets[0]))


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    bounds, coded = _bounds(lists), lists.flatten().dictionary_encode()
    with_word = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    held = with_word[line]
    line, own = line[held], own[held]
    first = np.unique(own * max(len(with_word), 1) + line) // max(len(with_word), 1)
    return np.bincount(own, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _repeated_words(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in windows that a text has twice or more. Equal hashes are compared word by word."""
    n, out = np.diff(bounds), np.zeros(len(bounds) - 1, np.int64)
    if len(word) < WINDOW + 1:
        return out
    mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    size = len(word) - WINDOW + 1
    hashed = np.zeros(size, np.uint64)
    for k in range(WINDOW):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + size]
    own = np.repeat(np.arange(len(n)), n)[:size]
    start = np.flatnonzero(np.arange(size) + WINDOW <= bounds[own + 1])
    key = hashed[start] ^ (own[start].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return out
    at = start[order]
    pair = np.flatnonzero(same)
    windows = np.lib.stride_tricks.sliding_window_view(word, WINDOW)
    true = (own[at[pair]] == own[at[pair + 1]]) & (windows[at[pair]] == windows[at[pair + 1]]).all(1)
    covered = np.zeros(len(word) + 1, np.int64)
    if true.all():
        hit = np.unique(np.concatenate([at[pair], at[pair + 1]]))
    else:  # a hash that two different windows share: group by the words themselves
        seen: dict[tuple, list[int]] = {}
        for x in np.unique(np.concatenate([at[pair], at[pair + 1]])).tolist():
            seen.setdefault((int(own[x]), windows[x].tobytes()), []).append(x)
        hit = np.array(sorted(x for v in seen.values() if len(v) > 1 for x in v), np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    return _per_text(np.cumsum(covered)[:-1] > 0, bounds)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules for texts without nulls."""
    lists = pc.ascii_split_whitespace(texts)
    bounds, coded = _bounds(lists), lists.flatten().dictionary_encode()
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    word = coded.indices.to_numpy()
    real = length[word] > 0 if len(word) else np.zeros(0, bool)
    bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
    word = word[real]
    n = np.diff(bounds)
    repeats = _repeated_words(word, bounds)
    return {
        "n_words": n,
        "word_chars": _per_text(length[word], bounds),
        "n_symbols": _symbols(texts),
        "n_dup_lines": _duplicate_lines(texts),
        "n_repeat_words": repeats,
        "base_failed": (n < 20) | (100 * repeats > 30 * n),
    }


def bands_of(texts: pa.Array, languages: list[str | None], bands: Mapping[str, Band], scripts: Mapping[str, Band]) -> list[Band]:
    beyond = pc.match_substring_regex(texts, _BEYOND_LATIN).to_numpy(zero_copy_only=False)
    out = []
    for k, (language, far) in enumerate(zip(languages, beyond, strict=True)):
        if language in bands:
            out.append(bands[language])
        elif not far:
            out.append(scripts["Latin"])
        else:
            out.append(scripts.get(script_of(texts[k].as_py()), OTHER))
    return out


def judge(texts: pa.Array, languages: list[str | None], encoder, bands: Mapping[str, Band] = LANGUAGES, scripts: Mapping[str, Band] = SCRIPTS) -> dict:
    """All features and the verdict for texts without nulls."""
    out = base_counts(texts)
    ids, offsets = encoder.encode_all(texts)
    n = np.diff(offsets)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    share = _per_text(encoder.is_byte[ids], offsets) / np.maximum(n, 1)
    ratio = chars / np.maximum(n, 1)
    entropy, kept = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for k, band in enumerate(bands_of(texts, languages, bands, scripts)):
        if n[k]:
            count = np.bincount(ids[offsets[k] : offsets[k + 1]])
            p = count[count > 0] / n[k]
            entropy[k] = -(p * np.log2(p)).sum()
        enough = entropy[k] >= min(band.entropy_share * math.log2(max(n[k], 1)), band.entropy)
        low, high = band.limits(int(n[k]))
        kept[k] = not out["base_failed"][k] and enough and (n[k] < band.least or low <= ratio[k] <= high and share[k] <= band.byte_share)
    return out | {"kept": kept, "n_tokens": n, "chars_per_token": ratio.round(6), "byte_share": share.round(6), "entropy": entropy.round(6) + 0.0}


def _clean(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def score_quality(docs: DataFrame, model: ModelFile, *, lang_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the features and ``kept`` for each row of ``docs``."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = documents(docs, lang.alias("lang"), id_col=id_col, text_col=text_col)

    def make():
        encoder = model.load()

        def work(batch):
            yield {"doc_id": batch.column("doc_id")} | judge(_clean(batch.column("text")), batch.column("lang").to_pylist(), encoder)

        return work

    return map_rows(rows, f"doc_id long, {FEATURES}", make)


def keep_quality(docs: DataFrame, model: ModelFile, *, lang_col: str | None = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def run(batches):
        encoder = model.load()
        for batch in batches:
            for part in cut(batch):
                names = part.schema.names
                text = pc.cast(part.column(names.index(text_col)), pa.string())
                languages = part.column(names.index(lang_col)).to_pylist() if lang_col in names else [None] * part.num_rows
                yield part.filter(pa.array(judge(_clean(text), languages, encoder)["kept"]))

    return map_batches(docs, run, docs.schema)
