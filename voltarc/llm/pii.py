"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are always reported when their own test holds. The method adds
kinds whose proposals need evidence: ``iban`` (mod-97), ``pan`` (a card number between separators
inside a longer run of digits, Luhn), ``ssn`` and ``tel`` (no checksum, so a context word nearby is
needed). An added span is reported if its score reaches ``THRESHOLD``.

The work is one pass over the texts with no shuffle; a task holds one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import others, shielded

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "pan", "ssn", "tel")
KINDS = BASE + ADDED
THRESHOLD = 0.6
CONTEXT_CHARS = 40  # how far from a span its context words may stand
#: Score of a proposal before and after its checksum, by kind.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.7, "iban": 0.3, "pan": 0.3, "ssn": 0.45,
         "tel": 0.35}
CHECKED = {"card": 0.4, "pan": 0.35, "iban": 0.6}
NEAR = {
    "email": r"e-?mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "pan": r"card|visa|credit|karte|tarjeta|carte",
    "ssn": r"ssn|social\s+security|tax\s+id",
    "tel": r"phone|call|\btel\b|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone",
}
AGAINST = r"order|invoice|version|serial|isbn|part\s+n|bestell|factura|facture"
CONTEXT_UP, CONTEXT_DOWN = 0.3, 0.2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_NEAR = {k: re.compile(v, re.IGNORECASE) for k, v in NEAR.items()}
_AGAINST = re.compile(AGAINST, re.IGNORECASE)

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One step per ``@``: the local part is the longest run before it that starts after the last
    match, which is where a scan from the left would have begun."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end, whether a checksum has confirmed it."""
    for start, end in _emails(text):
        yield "email", start, end, False
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
        elif len(digits) > 13:
            for start, end in _inside(m[0]):
                yield "pan", m.start() + start, m.start() + end, True
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end(), True
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False
    for m in _TEL.finditer(text):
        yield "tel", m.start(), m.end(), False


def _inside(run: str) -> Iterator[tuple[int, int]]:
    """Leftmost, longest stretches of whole digit groups of a failed run that pass Luhn."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    i = 0
    while i < len(groups):
        found, length = None, 0
        for j in range(i, len(groups)):
            length += groups[j][1] - groups[j][0]
            if length > 19:
                break
            if length >= 13 and (i, j) != (0, len(groups) - 1):
                if luhn(_digits(run[groups[i][0]:groups[j][1]])):
                    found = j
        if found is None:
            i += 1
        else:
            yield groups[i][0], groups[found][1]
            i = found + 1


def find(text: str | None) -> list[Span]:
    """(kind, start, end, score) by kind as in ``KINDS``, then start; code points, end exclusive."""
    if not text:
        return []
    out: list[Span] = []
    for kind, start, end, checked in _proposals(text):
        score = PRIOR[kind] + (CHECKED.get(kind, 0) if checked else 0)
        around = text[max(0, start - CONTEXT_CHARS):start] + "\n" + text[end:end + CONTEXT_CHARS]
        if _NEAR[kind].search(around):
            score += CONTEXT_UP
        if _AGAINST.search(around):
            score -= CONTEXT_DOWN
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one mark, named after the first of them."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def _detect(texts: pd.Series) -> pd.DataFrame:
    spans = [find(t) for t in texts]
    return pd.DataFrame({
        "spans": [[dict(zip(("kind", "start", "end", "score"), s)) for s in ss] for ss in spans],
        "redacted": [None if t is None else redact(t, ss) if ss else t
                     for t, ss in zip(texts, spans)]})


@shielded
def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii_spans`` (kind, start, end, score) and ``pii_redacted`` (text with marks).

    A NULL or empty text has no spans; a NULL stays NULL when redacted. Repeated rows stay
    repeated, ids are not read, an empty table stays empty. Input columns with the two result
    names are replaced. Whole texts are scanned; no expression backtracks over more than the run
    it stands in, so very long texts take linear time.
    """
    keep = others(docs, ["pii_spans", "pii_redacted"])
    found = F.pandas_udf(_detect, f"spans {SPAN_TYPE}, redacted string")
    return (docs.select(*keep, found(F.col(f"`{text}`")).alias("_pii"))
            .select(*keep, F.col("_pii.spans").alias("pii_spans"),
                    F.col("_pii.redacted").alias("pii_redacted")))


def joined(spans: str = "pii_spans", kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the given kinds, comma-joined in the spans' order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"],
                                                                  s["end"])), ",")
