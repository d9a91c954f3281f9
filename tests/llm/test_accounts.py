"""Identifiers after cues with the usual words between."""

import time

import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import pii  # noqa: E402

AUTOMATON = pii._automaton()
IBAN = "DE89 3704 0044 0532 0130 00"


def accounts(text):
    return [text[s:e] for s, k, e in pii.find(text, AUTOMATON)[1] if pii.KINDS[k] == "account"]


@pytest.mark.parametrize(
    "text, value",
    [
        ("Social Security Number: 123-45-6789", "123-45-6789"),
        ("SSN is 123-45-6789", "123-45-6789"),
        ("Social security no. is: 123-45-6789.", "123-45-6789"),
        ("Passport number: 123456789", "123456789"),
        ("Passport No. 123456789 then", "123456789"),
        ("account number is 12345678", "12345678"),
        ("Customer ID (12345678)", "12345678"),
        (f"IBAN number {IBAN}", IBAN),
        (f"IBAN no. {IBAN} then", IBAN),
        ("IBAN NO93 8601 1117 947", "NO93 8601 1117 947"),
        ("passport number " + "AB12-" * 9 + "77", "AB12-" * 9 + "77"),
    ],
)
def test_link_words(text, value):
    assert accounts(text) == [value]


def test_no_identifier():
    for text in ("passport number is missing", "SSN number is 000-12-3456", "IBAN number DE88 3704 0044 0532 0130 00", "passport nobody 123456", "account number of the month 123456", "passport number number number number number 123456"):
        assert accounts(text) == []


def test_cues_in_one_run_take_linear_time():
    began = time.time()
    pii.find("passport-" * 100_000 + "123456", AUTOMATON)
    pii.find("iban number " * 100_000, AUTOMATON)
    assert time.time() - began < 20
