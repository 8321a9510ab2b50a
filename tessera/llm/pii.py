"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

Base kinds (always kept when their own check passes): email, ip (parts at most 255), card
(16 to 19 digits, Luhn), phone (international, 8 to 15 digits). Added kinds are proposed by a
pattern with a prior score; a passed checksum raises it, a context word within
``CONTEXT`` characters raises it, and ``ACCEPT`` decides: iban (mod 97), ssn, local phone
numbers and credentials of any length, with dots inside. Added spans never overlap a span already accepted;
a credential that does is cut into what lies around that span.

A text is scanned in time linear in its length: patterns have no ambiguous repeats, and the
left part of an address is found from its ``@``. A map over the documents, nothing is shuffled.

Edge cases: null and empty texts have no spans and the digest of the empty string; spans
are code points, end exclusive; repeated rows each give a row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "credential")
KINDS = BASE + ADDED
CONTEXT = 48
ACCEPT = 0.6
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_CREDENTIAL = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?(?=(?:[A-Za-z0-9_/+=-]|\.(?=[A-Za-z0-9_/+=-])){12})([A-Za-z0-9_/+=-]++(?:\.[A-Za-z0-9_/+=-]++)*+)")
#: kind: pattern, prior score, words that raise it, what they add
PROPOSALS = {
    "iban": (_IBAN, 0.3, re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta)\b"), 0.2),
    "ssn": (_SSN, 0.4, re.compile(r"(?i)\b(?:ssn|social|security)\b"), 0.4),
    "local_phone": (_LOCAL_PHONE, 0.4, re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b"), 0.3),
    "credential": (_CREDENTIAL, 0.7, None, 0.0),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    taken, out = sorted((s, e) for _, s, e in base), []
    digits = bool(_DIGIT.search(text))
    for kind, (pattern, score, words, more) in PROPOSALS.items():
        if kind != "credential" and not digits or kind == "credential" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span(m.lastindex or 0)
            have = score
            if kind == "iban":
                if not mod97(m[0]):
                    continue
                have += 0.5
            if words is not None and words.search(text, max(0, s - CONTEXT), min(len(text), e + CONTEXT)):
                have += more
            if have < ACCEPT:
                continue
            over = sorted((a, b) for a, b in taken if a < e and s < b)
            if not over:
                pieces = [(s, e)]
            elif kind == "credential":  # a secret is taken whole: what the spans inside it leave of it
                pieces = [(x, y) for x, y in zip([s, *accumulate((b for _, b in over), max)], [*(a for a, _ in over), e]) if x < y]
            else:
                continue
            out += [(kind, x, y) for x, y in pieces]
            taken += pieces
    return out


def find(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each by kind as listed, then start."""
    if not text:
        return [], []
    order = lambda x: (KINDS.index(x[0]), x[1])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + added_spans(text, base), key=order)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(documents: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            counts = np.zeros((len(BASE), batch.num_rows), dtype=np.int64)
            digest, spans = [empty] * batch.num_rows, [""] * batch.num_rows
            for i, text in enumerate(batch.column(1)):
                base, every = find(text.as_py())
                if every:
                    for k, _, _ in base:
                        counts[BASE.index(k), i] += 1
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars, where there is such a column, follows the text."""
    names = documents.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [masked(t) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, type=pa.string())
            if count >= 0:
                n = cols[count].to_pylist()
                cols[count] = pa.array([len(b) if a is not b and a != b else k for a, b, k in zip(old, new, n)], type=cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return documents.mapInArrow(run, documents.schema)
