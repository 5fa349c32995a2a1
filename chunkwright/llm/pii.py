"""Personal data: Aho-Corasick anchors, expanded and validated by local parsers.

One automaton pass over a text finds at-signs, plus signs, digits, schemes and identifier cues. From each
anchor a deterministic parser for its kind reads the boundaries around it and validates what it has read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame

from . import common

#: The kinds in their order of report. The first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailto", "login", "iban", "ssn", "profile", "account")

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What follows a scheme or a cue: an address with a login, one of a person's page, an IBAN, a US social security number, an account's number.
LOGIN = re.compile(r"[a-z][a-z0-9+.-]*://([^\s/@:]+):([^\s/@]+)@[A-Za-z0-9.-]+", re.I | re.A)
PROFILE = re.compile(r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?/(?:[~@]|(?:in|user|users|u|people|profile|profiles|member|members)/)[A-Za-z0-9._-]*[A-Za-z0-9_]", re.I | re.A)
MAILTO = re.compile(r"mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.I | re.A)
AFTER_CUE = re.compile(r"[\s:#=.-]{0,4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}")
IN_IBAN = re.compile(r"\x20?[A-Z0-9]", re.I | re.A)
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
#: Cues in lower case; they are found in any.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "social security number": "ssn", "account number": "account", "account no": "account", "acct": "account"}
#: The length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """The check sum of ISO 13616: first four characters last, letters as 10 to 35, 1 modulo 97."""
    plain = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int | None:
    """Where the IBAN that begins at ``start`` ends: its country tells how many characters it has; single blanks between them don't count."""
    size = IBAN_LENGTHS.get(text[start : start + 2].upper())
    if size is None or not IBAN.match(text[start : start + 4].upper()):
        return None
    end = start + 4
    for _ in range(size - 4):
        m = IN_IBAN.match(text, end)
        if m is None:
            return None
        end = m.end()
    return None if text[end : end + 1].isalnum() else end


def folded(text: str) -> str:
    """``text`` in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton() -> ahocorasick.Automaton:
    """Anchors with (kind of anchor, length). A text of many digits yields each run once, see ``find``."""
    auto = ahocorasick.Automaton()
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    for digit in "0123456789":
        auto.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        auto.add_word(scheme, ("scheme", len(scheme)))
    for cue, kind in CUES.items():
        auto.add_word(cue, (kind, len(cue)))
    auto.make_automaton()
    return auto


def find(text: str, auto: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start; within a kind they don't overlap.

    An anchor before the end of the last span read for its kind is spent, whether that span was valid or
    not: a match that fails its validation is dropped and isn't tried again from within.
    """
    spans: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)
    digits_to = 0

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            spans.setdefault(kind, []).append((start, end))

    for last, (anchor, length) in auto.iter(folded(text)):
        at = last - length + 1
        if anchor == "digit":
            if at < digits_to:
                continue  # the rest of a run of digits whose first one was an anchor
            digits_to = at + 1
            while digits_to < len(text) and text[digits_to] in "0123456789":
                digits_to += 1
            start = max(at, done["ip"])
            if start < digits_to and (m := IP.match(text, start)):
                take("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()))
            start = max(at, done["card"])
            if start < digits_to and (m := CARD.match(text, start)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", *m.span(), 16 <= len(digits) <= 19 and luhn(digits))
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := EMAIL.match(text, start)):
                take("email", *m.span(), True)
        elif anchor == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                take("phone", *m.span(), 8 <= sum(c in "0123456789" for c in m[0]) <= 15)
        elif anchor == "scheme":
            for kind, pattern in (("mailto", MAILTO), ("login", LOGIN), ("profile", PROFILE)):
                if at >= done[kind] and (m := pattern.match(text, at)):
                    take(kind, *m.span(), True)
        else:
            start = AFTER_CUE.match(text, last + 1).end()
            if start < done[anchor]:
                continue
            if anchor == "iban":
                if end := iban_end(text, start):
                    take(anchor, start, end, iban_ok(text[start:end]))
            elif anchor == "ssn":
                if m := SSN.match(text, start):
                    take(anchor, *m.span(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")
            elif m := ACCOUNT.match(text, start):
                take(anchor, *m.span(), True)
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: Iterable[str]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans.get(kind, ()))


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``kind``, ``start``, ``end`` (code points, end exclusive), ``value``: one row for each span.

    A null or empty text has no spans. Rows are taken one by one: repeated rows give repeated results, null
    ids stay null, other columns are ignored. No shuffle.
    """
    auto = automaton()

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, text in batch:
            for kind, spans in find(text or "", auto).items():
                for start, end in spans:
                    yield doc_id, kind, start, end, text[start:end]

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, kind string, start long, end long, value string")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans and all spans as text.

    A null or empty text has no spans and the digest of the empty string. Rows are taken one by one:
    repeated rows give repeated results, null ids stay null, other columns are ignored. No shuffle.
    """
    auto = automaton()

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, text in batch:
            spans = find(text or "", auto)
            base = listed(spans, BASE)
            yield doc_id, *(len(spans.get(k, ())) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), listed(spans, KINDS)

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
