"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card (Luhn) and phone, each found leftmost and without overlap per kind;
a match that fails its test is dropped and not tried again. The method adds iban (mod-97) and
national ids whose nearby words speak for them. Every span has a score: a prior by kind, raised by
context words within ``NEAR`` characters before it. Base spans are kept whatever they score; added
ones need ``KEEP``.

Every pattern is anchored so that a text of n characters takes time in proportion to n.
Defined results: null is the empty text, without spans. Very long texts are searched whole. Offsets are
code points, end exclusive. Spans are ordered by start, then by kind as listed in KINDS, which also
settles ties of kinds that begin together; those of several kinds may overlap. Repeated rows each get a
row, an empty table gives none. Columns beside doc_id and text are ignored by ``find`` and kept by
``mask``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import SLICE_ROWS, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits can only be entered at its start, or each of its digits would scan it again.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
NEAR, BOOST, KEEP = 40, 0.35, 0.7
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address takes all of the run before its @, down to the end of the last address."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_SET:
            start -= 1
        nxt = at + 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            floor = nxt = m.end()
        else:
            floor = at + 1  # no local part reaches back over an @
        at = text.find("@", nxt)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a whole text, in order."""
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        found += [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m[0])]
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    out = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))):
        near = {w.lower() for w in WORDS.findall(text[max(0, a - NEAR) : a])}
        value = min(1.0, PRIOR[kind] + BOOST * any(w.startswith(c) for w in near for c in CONTEXT[kind]))
        if kind in BASE or value >= KEEP:
            out.append((kind, a, b, round(value, 3)))
    return out


DIGIT = re.compile("[0-9]")


def joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, scores) of every document."""

    def make():
        def run(texts: list) -> list:
            every = [spans(x) for x in texts]
            counts = [[sum(s[0] == k for s in found) for found in every] for k in BASE]
            digest = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in every]
            return [*counts, digest, [joined(f) for f in every], [[s[3] for s in f] for f in every]]

        return run

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))]
    return map_texts(docs, ["doc_id"], "text", make, fields)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return text if not at else "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked and n_chars, if there, set to the new length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                i = names.index("text")
                before = part.column(i).to_pylist()
                after = [masked(x) for x in before]
                part = part.set_column(i, part.schema.field(i), pa.array(after, part.schema.field(i).type))
                if "n_chars" in names:
                    j = names.index("n_chars")
                    n = [v if x == y or y is None else len(y) for x, y, v in zip(before, after, part.column(j).to_pylist(), strict=True)]
                    part = part.set_column(j, part.schema.field(j), pa.array(n, part.schema.field(j).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
