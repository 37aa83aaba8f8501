"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, address schemes, digit pairs
and dots between digits, plus-digits, country codes of bank accounts, and identifier cues. A small deterministic parser per
kind expands an anchor to the borders of its span and validates it. Matches of a kind never
overlap, and a failing one is dropped without a second try.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_python

BASE = ["email", "ip", "card", "phone"]
MORE = ["url", "iban", "account"]       # URLs with user data, bank accounts, and values after an identifier cue
KINDS = BASE + MORE
# Words that announce an identifier (fixed values).
CUES = ["access_key", "account", "acct", "api-key", "api_key", "apikey", "login", "passwd", "password", "private_key", "secret", "secret_key", "token",
        "user", "userid", "username"]
# Length of a bank account number of ISO 13616 by country (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER_URL = re.compile(r"://[^\s/@:<>\"']+(?::[^\s/@<>\"']*)?@[^\s<>\"']+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*")
_VALUE = re.compile(r"[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_.-]{4,}[A-Za-z0-9])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_end(text: str, at: int) -> int | None:
    """Where the bank account that starts at ``at`` ends: as many characters as its country has, in blocks or not."""
    m = _IBAN.match(text, at, at + 2 * IBAN_LENGTH.get(text[at:at + 2], 0))
    if m is None or (at and text[at - 1].isalnum()):
        return None
    ends = [i for i in range(at, m.end()) if text[i] != " "][:IBAN_LENGTH[text[at:at + 2]]]
    end = ends[-1] + 1
    complete = len(ends) == IBAN_LENGTH[text[at:at + 2]] and not text[end:end + 1].isalnum()
    return end if complete and _iban_valid(text[at:end].replace(" ", "")) else None


def automaton() -> ahocorasick.Automaton:
    """All anchors; each has its kind and its length."""
    anchors = {"@": "email", "://": "url"}
    for a in "0123456789":
        anchors["+" + a] = "phone"
        for b in "0123456789":
            anchors |= {a + b: "card", f"{a} {b}": "card", f"{a}-{b}": "card", f"{a}.{b}": "ip"}
    anchors |= {country + a: "iban" for country in IBAN_LENGTH for a in "0123456789"}
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            anchors[form] = "cue"
    found = ahocorasick.Automaton()
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _left(text: str, at: int, allowed: frozenset, stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, by kind and start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)      # end of the last match of a kind, valid or not

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            spans[kind].append((start, end))

    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "email":
            start = _left(text, at, _LOCAL, done[kind])
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take(kind, start, m.end())
        elif kind == "ip":
            if at >= done[kind] and (m := _IP.match(text, _left(text, at, _DIGITS, done[kind]))):
                take(kind, m.start(), m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))))
        elif kind == "card":
            if at >= done[kind] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take(kind, at, m.end(), 16 <= len(digits) <= 19 and _luhn(digits))
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                take(kind, at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif kind == "url":
            start = _left(text, at, _SCHEME, done[kind])
            if start < at and (m := _USER_URL.match(text, at)):
                take(kind, start, m.end())
        elif kind == "iban":
            if at >= done[kind] and (end := _iban_end(text, at)):
                take(kind, at, end)
        elif (m := _VALUE.match(text, last + 1)) and m.start(1) >= done["account"] and not _DIGITS.isdisjoint(m[1]) and not _iban_end(text, m.start(1)):
            take("account", m.start(1), m.end(1))
    return [(k, *s) for k in KINDS for s in spans[k]]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more) per row of ``docs`` (doc_id, text, ...).

    spans: kind:start:end of all spans, by kind and start, comma-joined; base_sha256: SHA-256
    of the same text of the four base kinds. n_more: spans of the other kinds.

    Null texts are empty. Repeated rows get equal results. An empty table gives an empty
    result. Other columns are not read. Texts are read whole.
    """
    held: list = []

    def compute(texts: list) -> list:
        if not held:
            held.append(automaton())
        rows = []
        for text in texts:
            spans = find(text, held[0]) if text else []
            base = [s for s in spans if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(),
                         written(spans), len(spans) - len(base)))
        return list(zip(*rows)) or [[]] * 7

    fields = {**{f"n_{k}": T.LongType() for k in BASE}, "base_sha256": T.StringType(), "spans": T.StringType(), "n_more": T.LongType()}
    return with_python(docs.select("doc_id", "text"), "text", fields, compute)


def masked(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for start, end, kind in parts:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
