"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, identifier cues). From each anchor a deterministic
parser walks left and right over the characters that the kind allows and validates what it holds. No pattern
backtracks, so a text of any length takes linear time.

Kinds in the order of the list: ``email``, ``ip``, ``card``, ``phone`` (the base kinds, by fixed grammars), then what
only the method finds: ``mailbox`` (an address with letters beyond ASCII), ``address`` (a URL with a user in it or
with a literal host address), ``account`` (an identifier after a cue: IBAN, social security and other numbers) and
``secret`` (a token, key or password that a cue assigns, or a token that its own prefix names). Cues are found in any
case. A value is taken whole or not at all: what goes on beyond the form of its kind is no value of it.

Defined results: a null text is empty and has no spans; null ids and repeated rows pass through; an empty table
gives an empty result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from ._common import documents, map_rows, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "address", "account", "secret")
Span = tuple[int, int, int]  # start, index of the kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_URL_ENDS = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
_SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "ldap://", "smb://")
#: Words that announce an identifier, and what it must look like.
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "passport": "number", "account number": "number", "account no": "number", "acct no": "number", "customer id": "number", "driver's license": "number", "tax id": "number"}
#: Words to which secrets are assigned: long random ones, and ones that people choose.
_CUES |= dict.fromkeys(("token", "secret", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "secret key", "secret_key", "private key", "private_key", "auth_token", "access_token", "client_secret", "bearer"), "token")
_CUES |= dict.fromkeys(("password", "passwd", "passphrase", "pwd"), "password")
#: How well-known tokens begin, and what follows. Fixed values.
_PREFIXES = {"akia": r"AKIA[0-9A-Z]{16}", "ghp_": r"ghp_[0-9A-Za-z]{36}", "xoxb-": r"xoxb-[0-9]+-[0-9]+-[0-9A-Za-z]{16,}", "sk_live_": r"sk_live_[0-9A-Za-z]{16,}", "-----begin ": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"}
_TOKENS = {k: re.compile(v + r"(?![0-9A-Za-z])") for k, v in _PREFIXES.items()}
#: Words that may stand between a cue and its identifier, and how many of them.
_LINKS, _MOST_LINKS = frozenset(("number", "num", "no", "nr", "id", "code", "is", "was", "of")), 4
_LONGEST_LINK = max(map(len, _LINKS))
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_SSN = re.compile(r"[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}(?!-?[0-9A-Za-z])")
_ASSIGNED = re.compile(r"[\"'\]]?[ \t]*(?:[:=]+>?|\bis\b)[ \t]*[\"'`]?")
_TOKEN = re.compile(r"[A-Za-z0-9_.+/~-]+={0,2}")
_CHOSEN = re.compile(r"[^\s\"'`,;<>]+")
_IBAN_MOST = 34  # letters and digits, by the standard


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", ""))
    for word in _SCHEMES:
        found.add_word(word, ("scheme", word))
    for word, kind in _CUES.items():
        found.add_word(word, (kind, word))
    for word in _PREFIXES:
        found.add_word(word, ("prefix", word))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """In lower case, with as many characters."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _label_end(text: str, at: int, label) -> int:
    n = len(text)
    while at < n and label(text[at]):
        at += 1
    return at


def _domain_end(text: str, at: int, label) -> int:
    """The end of two or more labels joined by dots from ``at``, or -1."""
    end, dots = _label_end(text, at, label), 0
    if end == at:
        return -1
    while end + 1 < len(text) and text[end] == "." and label(text[end + 1]):
        end = _label_end(text, end + 1, label)
        dots += 1
    return end if dots else -1


def emails(text: str, ats: list[int]) -> Iterator[Span]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from the at-signs."""
    free = 0
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _domain_end(text, at + 1, _LABEL.__contains__) if start < at else -1
        if end > 0:
            yield start, 0, end
            free = end


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """The starts and ends of the stretches that the spans (by start) cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def mailboxes(text: str, ats: list[int], taken: list[Span]) -> Iterator[Span]:
    """Addresses around at-signs that no base span covers, with letters of any script."""
    starts, ends = _merged(taken)
    overlaps = lambda s, e: (k := bisect_left(starts, e)) > 0 and ends[k - 1] > s
    local = lambda c: c in _LOCAL or not c.isascii() and c.isalnum()
    label = lambda c: c in _LABEL or not c.isascii() and c.isalnum()
    free = 0
    for at in ats:
        if at < free or overlaps(at, at + 1):
            continue
        start = at
        while start > free and local(text[start - 1]):
            start -= 1
        end = _domain_end(text, at + 1, label) if start < at else -1
        if end > 0 and text[end - 1].isalpha() and not overlaps(start, end):
            yield start, KINDS.index("mailbox"), end
            free = end


def ips(text: str) -> Iterator[Span]:
    """Four dotted numbers up to 255: a chain of dotted numbers falls into fours from its left."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        at, numbers = chain.start(), chain[0].split(".")
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := n.lstrip("0")) <= 3 and int(x or 0) <= 255 for n in four):
                yield at, 1, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 10 + d % 10 for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()


def phones(text: str) -> Iterator[Span]:
    """``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits: what the run holds up to its last digit."""
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        run = m[0].rstrip(" ().-")
        if len(run) >= 4 and 9 <= sum(c in _DIGIT for c in run) <= 15:
            yield m.start(), 3, m.start() + len(run)


def addresses(text: str, schemes: list[tuple[int, int]]) -> Iterator[Span]:
    """URLs from their schemes (start, host) that name a user or whose host is a literal address.

    A URL within another one ends where that one does, so its end isn't looked for again.
    """
    stop = 0
    for start, host in schemes:
        if host > stop:
            stop = host
            while stop < len(text) and text[stop] not in _URL_ENDS:
                stop += 1
        end = stop
        while end > host and text[end - 1] in ".,;:!?)]'":
            end -= 1
        at = host
        while at < end and text[at] not in "/?#":
            at += 1
        user, sign, name = text[host:at].rpartition("@")
        literal = name[1:].partition("]")[0] if name.startswith("[") else name.partition(":")[0]
        try:
            ipaddress.ip_address(literal)
        except ValueError:
            if not (sign and user and name):
                continue
        yield start, KINDS.index("address"), end


def _iban(value: str) -> bool:
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _value_start(text: str, at: int) -> int:
    """Where the value after a cue begins: past signs and up to ``_MOST_LINKS`` link words ("number is")."""
    for left in range(_MOST_LINKS, -1, -1):
        start = at
        while start < len(text) and text[start] in " .:#=-()":
            start += 1
        end = start
        while end < len(text) and end - start <= _LONGEST_LINK and text[end].isalpha():
            end += 1
        if not left or text[start:end].lower() not in _LINKS or end < len(text) and text[end].isalnum():
            break
        at = end
    return start


class Runs:
    """ASCII letters and digits joined by single hyphens, each run read once: cues may be many within one."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.digits = text, 0, 0, []

    def end_of(self, start: int) -> tuple[int, int]:
        """The end of the run from ``start`` and its digits."""
        if not self.start <= start < self.end:
            text, end = self.text, start
            while end < len(text) and text[end].isascii() and (text[end].isalnum() or text[end] == "-" and end > start and text[end - 1] != "-"):
                end += 1
            self.start, self.end = start, end
            self.digits = [k for k in range(start, end) if text[k] in _DIGIT]
        end = self.end
        while end > start and self.text[end - 1] == "-":
            end -= 1
        return end, len(self.digits) - bisect_left(self.digits, start)


def account(text: str, kind: str, cue: int, at: int, runs: Runs) -> Span | None:
    """An identifier that follows a cue within a few signs and link words, by the rules of its kind."""
    if cue and text[cue - 1].isalnum() or at < len(text) and text[at].isalnum():
        return None
    start = _value_start(text, at)
    if kind == "number":
        end, digits = runs.end_of(start)
        return (start, KINDS.index("account"), end) if digits >= 6 and text[start].isalnum() else None
    if kind == "iban":
        end = _iban_end(text, start)
        return (start, KINDS.index("account"), end) if end else None
    m = _SSN.match(text, start)
    return (start, KINDS.index("account"), m.end()) if m and m[0][:3] not in ("000", "666") and m[0][0] != "9" else None


def _iban_end(text: str, start: int) -> int:
    """The end of the longest valid IBAN from ``start`` that ends with a word, or 0; single blanks and hyphens may part it."""
    ends, held, at = [], 0, start
    while at < len(text) and held <= _IBAN_MOST and text[at].isascii():
        if text[at].isalnum():
            held += 1
        elif text[at] in " -" and at > start and text[at - 1].isalnum():
            ends.append(at)
        else:
            break
        at += 1
    if held <= _IBAN_MOST and at > start and text[at - 1].isalnum() and (at == len(text) or not text[at].isalnum()):
        ends.append(at)
    return next((e for e in reversed(ends) if _iban(text[start:e].replace(" ", "").replace("-", "").upper())), 0)


class Chosen:
    """What follows the cue of a password up to white space, a quote or a comma; each run is read once."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, 0

    def end_of(self, start: int) -> int:
        if not self.start <= start < self.end:
            m = _CHOSEN.match(self.text, start)
            self.start, self.end = start, m.end() if m else start
        return self.end


def secret(text: str, kind: str, cue: int, at: int, chosen: Chosen) -> Span | None:
    """A secret that is assigned to a cue ("token = ...") or that a prefix begins.

    A random one has 16 characters or more with a letter and a digit among them; a chosen one has six or more and, if it
    isn't in quotes, a digit.
    """
    if cue and text[cue - 1].isalnum():
        return None
    if kind == "prefix":
        m = _TOKENS[text[cue:at].lower()].match(text, cue)
        return (cue, KINDS.index("secret"), m.end()) if m else None
    sign = _ASSIGNED.match(text, at)
    if not sign and not (text[cue:at].lower() == "bearer" and text.startswith(" ", at)):
        return None
    start = sign.end() if sign else at + 1
    if kind == "token":
        m = _TOKEN.match(text, start)
        value = m[0].rstrip(".") if m else ""
        real = len(value) >= 16 and any(c in _DIGIT for c in value) and any(c.isalpha() for c in value)
    else:
        value = text[start : chosen.end_of(start)]
        real = len(value) >= 6 and (text[start - 1] in "\"'`" or any(c in _DIGIT for c in value))
    return (start, KINDS.index("secret"), start + len(value)) if real else None


def find(text: str, automaton) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans of a text, each by start and kind."""
    ats, schemes, cues = [], [], []
    for last, (kind, word) in automaton.iter(_lower(text)):
        if kind == "at":
            ats.append(last)
        elif kind == "scheme":
            schemes.append((last + 1 - len(word), last + 1))
        else:
            cues.append((kind, last + 1 - len(word), last + 1))
    base = sorted([*emails(text, ats), *ips(text), *cards(text), *phones(text)])
    more = [*mailboxes(text, ats, base)] if ats else []
    more += addresses(text, schemes)
    runs, chosen = Runs(text), Chosen(text)
    more += [s for x in cues if (s := secret(text, *x, chosen) if x[0] in ("token", "password", "prefix") else account(text, *x, runs))]
    return base, sorted({*base, *more})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts of the base kinds, the SHA-256 of the base spans, all spans and their number in each row."""
    none = hashlib.sha256(b"").hexdigest()

    def make():
        automaton = _automaton()

        def work(batch):
            counts, digests, spans, total = [], [], [], []
            for text in texts_of(batch):
                base, every = find(text, automaton)
                counts.append([sum(k == x for _, k, _ in base) for x in range(4)] if base else (0, 0, 0, 0))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else none)
                spans.append(joined(every))
                total.append(len(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield {"doc_id": batch.column("doc_id"), "base_sha256": digests, "spans": spans, "n_spans": np.array(total, np.int64)} | {f"n_{k}": n[:, i] for i, k in enumerate(BASE)}

        return work

    return map_rows(documents(docs, id_col=id_col, text_col=text_col), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", make)
