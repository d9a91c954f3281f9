"""Licence scans by patience alignment.

A template and a stretch of text are aligned on the words that are unique to both: the longest increasing
subsequence of their positions gives the anchors, and the gaps between anchors are aligned the same way, with words
that are unique within them. A template's coverage is the share of its words that are aligned.

Which templates to align follows from a bound that loses nothing: coverage ``t`` needs ``t`` of the template's words,
thus all but ``(1 - t) * words`` of its distinct words. Of a text that has so many, all windows of twice the template's
length with so many are aligned first, with short gaps at their ends, so that close copies are found one by one.
Copies close together leave few words unique in such a window. Where it gives nothing, or a match longer than a copy,
narrower windows are aligned, from each place where a copy may begin by the rarest of its words; what is left on both
sides of a match is looked through again. Last, each stretch between the matches is aligned whole and with gaps of any
length: a licence counts however many foreign words stand in it, and what ``align`` covers in a whole text is found.
One-line statements must be there in full and without other words between; a line within a longer match of the same
licence goes.

Defined results: words are compared in lower case without ASCII signs; null and empty texts have no licence; of
overlapping matches the one with more aligned words stays, then the one with more coverage, then the first in the
list, then the shorter; null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import documents, map_rows
from .templates import TEMPLATES
from .words import normalised, words_of

COVERAGE = 0.8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Template:
    license: str
    kind: str
    words: list[str]
    least: float
    distinct: frozenset[str] = field(default=frozenset())

    @property
    def needed(self) -> int:
        """Distinct words that a text with enough coverage can't lack."""
        return len(self.distinct) - int((1 - self.least) * len(self.words) + 1e-9)


def templates(coverage: float = COVERAGE, texts: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    out = []
    for name, kind, text in texts:
        words = normalised(pa.array([text]))[0].as_py().split()
        out.append(Template(name, kind, words, 1.0 if kind == "line" else coverage, frozenset(words)))
    return out


def from_folder(path: str) -> list[tuple[str, str, str]]:
    """The built-in texts and the files of a folder of whole licence texts, named as the files are."""
    return [*TEMPLATES, *((f.name, "text", f.read_text("utf-8", "replace")) for f in sorted(Path(path).iterdir()) if f.is_file() and not f.is_symlink())]


def _increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence, by patience: piles with the least end of each length."""
    ends, piles, back = [], [], []
    for k, v in enumerate(values):
        p = bisect_left(ends, v)
        back.append(piles[p - 1] if p else -1)
        if p == len(ends):
            ends.append(v)
            piles.append(k)
        else:
            ends[p], piles[p] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str], *, near: bool = False) -> list[tuple[int, int]]:
    """Pairs of places in ``a`` and ``b`` with equal words, increasing in both.

    ``near``: only words near the first and last anchors are aligned before and after them, so that a match is narrow.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k] and (out or i or k):
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1] and (j < len(a) or n < len(b)):
            j, n = j - 1, n - 1
            out.append((j, n))
        if i >= j or k >= n:
            continue
        mine, theirs = Counter(a[i:j]), Counter(b[k:n])
        place = {b[y]: y for y in range(k, n) if theirs[b[y]] == 1}
        common = [(x, place[a[x]]) for x in range(i, j) if mine[a[x]] == 1 and a[x] in place]
        anchors = [common[x] for x in _increasing([y for _, y in common])]
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, n)], strict=True):
            if x2 - x > 1 and y2 - y > 1:
                wide = (x2 - x) * 3 // 2 + 4  # the template's own gap, and half as much
                if near and y == k - 1 and i == 0:
                    y = max(y, y2 - wide)
                if near and y2 == n and j == len(a):
                    y2 = min(y2, y + wide)
                todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def scan(words: Sequence[str], template: Template) -> list[tuple[int, int, int]]:
    """Matches of a template in a text's words: aligned words, first word, end."""
    size = len(template.words)
    places = [k for k, w in enumerate(words) if w in template.distinct]
    out = []
    if template.kind == "line":
        first = template.words[0]
        return [(size, k, k + size) for k in places if words[k] == first and list(words[k : k + size]) == template.words]
    step = size + size // 4 + 8
    todo = [(k, min(k + 2 * step, len(words))) for k in sorted({k // step * step for k in places} | {max(0, k // step * step - step) for k in places})]
    tried = set()
    while todo:
        low, high = todo.pop()
        if (low, high) in tried:
            continue
        tried.add((low, high))
        part = words[low:high]
        if len(template.distinct.intersection(part)) < template.needed:
            continue
        one = _aligned(words, template, low, high)
        found = [one] if one else []
        if not one or one[2] - one[1] > step:  # nothing, or maybe the words of several copies
            near = [x for k in _starts(part, template, step - size) if (x := _aligned(words, template, max(low, low + k - (step - size)), min(high, low + k + step)))]
            found = [x for x in near if x[2] - x[1] <= step] or found
        out += found
        for _, s, e in found:
            todo += [(low, s), (e, high)]
    taken = sorted((s, e) for _, s, e in out)
    low = 0
    for s, e in [*taken, (len(words), len(words))]:
        if s > low and len(template.distinct.intersection(words[low:s])) >= template.needed:
            out += [one] if (one := _aligned(words, template, low, s, near=False)) else []
        low = max(low, e)
    return sorted(set(out))


def _aligned(words: Sequence[str], template: Template, low: int, high: int, near: bool = True) -> tuple[int, int, int] | None:
    """Aligned words, first word and end of the template's alignment with a stretch, if it covers enough."""
    pairs = align(template.words, words[low:high], near=near)
    if not pairs or len(pairs) < template.least * len(template.words) - 1e-9:
        return None
    return len(pairs), low + pairs[0][1], low + pairs[-1][1] + 1


def _starts(part: Sequence[str], template: Template, slack: int) -> list[int]:
    """Where copies may begin: by the places of the rarest template words, of which a copy has one; half the slack apart."""
    counts = Counter(part)
    rare = set(sorted(template.distinct, key=lambda w: (counts[w], w))[: len(template.distinct) - template.needed + 1])
    own: dict[str, list[int]] = {}
    for k, w in enumerate(template.words):
        if w in rare:
            own.setdefault(w, []).append(k)
    wide = max(1, slack // 2)
    return sorted({(k - x) // wide * wide for k, w in enumerate(part) if w in rare for x in own[w]})


def find(words: Sequence[str], candidates: Sequence[Template]) -> list[tuple[str, float, int, int]]:
    """Licences in a text's words: name, coverage, first word, end; matches don't overlap."""
    found = []
    for order, template in enumerate(candidates):
        found += [(-n, -n / len(template.words), order, e - s, s, e, template.license) for n, s, e in scan(words, template)]
    kept: list[tuple[str, float, int, int]] = []
    for _, coverage, _, _, s, e, name in sorted(found):
        if all(e <= a or b <= s for _, _, a, b in kept):
            kept.append((name, -coverage, s, e))
    return sorted(kept, key=lambda x: x[2])


def find_licenses(docs: DataFrame, *, coverage: float = COVERAGE, texts: Sequence[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``license`` (the one with the most aligned words), its ``coverage``, ``n_licenses`` and ``spans``.

    ``texts`` are the templates (name, kind and text); ``from_folder`` adds whole texts to the built-in ones.
    ``spans`` holds ``license:start:end`` of each match in code points (of the lower-cased text, whose length differs
    from the text's for a few letters such as capital I with a dot), joined by commas.
    """
    every = templates(coverage, texts)

    def make():
        vocabulary = {w: k for k, w in enumerate(sorted({w for t in every for w in t.distinct}))}
        member = np.zeros((len(vocabulary), len(every)), np.float32)
        for k, t in enumerate(every):
            member[[vocabulary[w] for w in t.distinct], k] = 1
        needed = np.array([t.needed for t in every])

        def work(batch):
            text = pc.fill_null(batch.column("text"), "")
            distinct, word, bounds = words_of(text)
            known = np.array([vocabulary.get(w, -1) for w in distinct], np.int64)[word] if distinct else np.zeros(0, np.int64)
            at = np.flatnonzero(known >= 0)
            present = np.zeros((len(text), len(vocabulary)), np.float32)
            present[np.searchsorted(bounds, at, "right") - 1, known[at]] = 1
            possible = present @ member >= needed
            n = len(text)
            out = {"doc_id": batch.column("doc_id"), "license": [None] * n, "coverage": [0.0] * n, "n_licenses": [0] * n, "spans": [""] * n}
            for k in np.flatnonzero(possible.any(1)).tolist():
                words = [distinct[w] for w in word[bounds[k] : bounds[k + 1]].tolist()]
                matches = find(words, [every[x] for x in np.flatnonzero(possible[k])])
                if matches:
                    places = [(m.start(), m.end()) for m in _WORD.finditer(normalised(text[k : k + 1])[0].as_py())]
                    best = max(matches, key=lambda m: (m[3] - m[2], m[1], -m[2]))
                    out["license"][k], out["coverage"][k], out["n_licenses"][k] = best[0], round(best[1], 6), len(matches)
                    out["spans"][k] = ",".join(f"{name}:{places[s][0]}:{places[e - 1][1]}" for name, _, s, e in matches)
            yield out

        return work

    return map_rows(documents(docs, id_col=id_col, text_col=text_col), "doc_id long, license string, coverage double, n_licenses long, spans string", make)
