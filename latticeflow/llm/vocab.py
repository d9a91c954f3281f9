"""Exact encoders for the public vocabularies, fast where words come back.

Both encoders cut a text where the library provably never merges across, encode each distinct part once per
worker, and join the ids; the tests hold them against the libraries on whole texts. The model file is read on
the driver (0.5 to 2 MB) and travels as bytes, so that executors need no path.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array as pack
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts that a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 100_000
#: Longer parts aren't remembered.
LONGEST = 64

_LOADED: dict[tuple[str, str], object] = {}


class ModelFile:
    """A vocabulary file as bytes, with the digest that names this version of tokenizer and library."""

    def __init__(self, path: str):
        self.kind = "piece" if path.endswith(".model") else "word"
        self.data = Path(path).read_bytes()
        if self.kind == "piece":
            import sentencepiece as library
        else:
            import tokenizers as library
        self.version = hashlib.sha256(self.data + f"|{library.__name__}|{library.__version__}".encode()).hexdigest()

    def load(self):
        """The encoder; a worker process keeps the last one."""
        key = (self.kind, self.version)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = PieceEncoder(self.data) if self.kind == "piece" else WordEncoder(self.data)
        return _LOADED[key]


def _joined(ids: list[bytes], index: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts ``index`` names, in one array, and where each part ends in it."""
    width = np.dtype(dtype).itemsize
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(ids), dtype)
    own = lengths[index]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - own), own)
    return flat[at], ends


class _Encoder:
    """Cuts a batch of texts into parts, encodes parts not met before, and joins the parts' ids."""

    dtype: type
    cuts: bool

    def __init__(self):
        self._memory: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> np.ndarray:
        """The library's ids of a whole text."""
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in one array, and the ``len(texts) + 1`` offsets of the texts in it."""
        n = len(texts)
        if not n:
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        lists = self._cut(texts)
        coded = lists.flatten().dictionary_encode()
        parts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        ids, ends = _joined(self._ids(parts), index, self.dtype)
        offsets = np.concatenate(([0], ends))[bounds]
        odd = self._odd(texts)
        if len(odd):
            pieces = [ids[offsets[k] : offsets[k + 1]] for k in range(n)]
            for k in odd.tolist():
                pieces[k] = self.whole(texts[k].as_py())
            ids = np.concatenate(pieces)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        return ids, offsets

    def _ids(self, parts: list[str]) -> list[bytes]:
        known = self._memory
        found = list(map(known.get, parts))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            for k, x in zip(new, self._learned([parts[k] for k in new]), strict=True):
                found[k] = x
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                known[""] = b""
            known.update((parts[k], found[k]) for k in new[:REMEMBERED] if len(parts[k]) <= LONGEST)
        return found


class PieceEncoder(_Encoder):
    """sentencepiece ids without begin or end.

    If no piece has the space mark after another character and the normaliser leaves text alone, no merge
    crosses a single space, and texts are cut there. Texts with runs of spaces, spaces at an end or the mark
    itself go to the library whole, as all texts do under another kind of file.
    """

    dtype = np.uint16

    def __init__(self, data: bytes):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.library.get_piece_size()
        if self.size >= 1 << 16:
            self.dtype = np.uint32
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(self.size)])
        self._starts = np.array([p.startswith("▁") for p in pieces])
        probe = "ﬁ ①Ａ  x\t  é "
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.library.Normalize(probe) == "▁" + probe.replace(" ", "▁")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), self.dtype)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def _odd(self, texts: pa.Array) -> np.ndarray:
        if not self.cuts:
            return np.arange(len(texts))
        return np.flatnonzero(pc.match_substring_regex(texts, "^ |  | $|▁").to_numpy(zero_copy_only=False))

    def _learned(self, parts: list[str]) -> list[bytes]:
        """One string of several parts; its ids fall apart again where a piece begins with the mark.

        A part that has the mark itself may join the one after it; parts beside one are encoded one by one.
        """
        out = []
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            joined = " ".join(some)
            ids = np.array(self.library.encode(joined), self.dtype)
            starts = np.flatnonzero(self._starts[ids]).tolist()
            if len(starts) != len(some) or not all(some) or "▁" in joined:
                out += [self.whole(x).tobytes() for x in some]
                continue
            raw, width = ids.tobytes(), ids.itemsize
            out += [raw[a * width : b * width] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        return out


class WordEncoder(_Encoder):
    """Ids of a ``tokenizers`` file, without added special tokens.

    Where the file's normaliser and splitter are the known lower-casing word splitter that drops white space,
    texts are cut at ASCII white space, and parts of letters up to U+024F are merged by rank without the
    library's offsets. Any other part, and any text under another file, goes to the library itself.
    """

    dtype = np.uint32
    _normalizer = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    _pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: The same pattern for text up to U+024F, in terms of the standard library, whose \\w also holds ² ³ ¹ ¼ ½ ¾.
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|[\W_]+")

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(data)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
        model = spec["model"]
        self.size = self.library.get_vocab_size()
        self.cuts = (
            spec["normalizer"] == self._normalizer and steps[0].get("pattern") == {"Regex": self._pattern} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and len(steps) == 2 and spec["post_processor"] is None
            and not any("|" not in x["content"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        )
        self._special = [x["content"] for x in spec["added_tokens"]]
        self._merge = self._ranked(model) if self.cuts and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") else None
        self._words: dict[str, bytes] = {}

    def _ranked(self, model: dict):
        """The merges as ranks over bytes. The last byte of a word and the end mark 0xFF, which UTF-8 never has, join first."""
        import tiktoken

        byte = {c: b for b, c in _byte_letters().items()}
        raw = lambda token: bytes(byte[c] for c in token.removesuffix("</w>")) + (b"\xff" if token.endswith("</w>") else b"")
        ids = {raw(token): i for token, i in model["vocab"].items() if not token.startswith("<|")}
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b, 255])] = len(ranks)
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = raw(left) + raw(right)
            if token in ranks:
                return None
            ranks[token] = len(ranks)
        named = [ids.get(token) for token in ranks]
        piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda word: pack("I", [named[r] for r in piece(word.encode() + b"\xff")]).tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        return np.empty(0, np.int64) if self.cuts else np.arange(len(texts))

    def _learned(self, parts: list[str]) -> list[bytes]:
        words, merge, split, out = self._words, self._merge, self._split.findall, []
        if len(words) > REMEMBERED:
            words.clear()
        for part in parts:
            if merge and (part.isascii() or part.isprintable() and max(part) < "ɐ") and not ("|" in part and any(x in part for x in self._special)):
                ids = b""
                for word in split(part.lower()):
                    own = words.get(word)
                    if own is None:
                        own = merge(word)
                        if len(word) <= LONGEST:
                            words[word] = own
                    ids += own
                out.append(ids)
            else:
                out.append(self.whole(part).tobytes())
        return out


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
