"""Personal data: patterns propose spans, validators confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed order of the base kinds, then of the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive, and only at the start of a run of digits: the same matches in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[0-9]")

#: Words that raise a span's score if they stand within NEAR characters before or after it.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
NEAR = 40
#: Score of a confirmed span without context, by kind; context adds BOOST; added kinds need LEAST.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
BOOST, LEAST = 0.35, 0.6
WORDS = {k: re.compile(rf"(?<![a-z])(?:{'|'.join(v)})(?![a-z])", re.IGNORECASE) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@dataclass(frozen=True, slots=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: the local part can only be the run before it, so the time is linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, of spans that their validator confirms; failing matches are dropped."""
    for s, e in emails(text):
        yield "email", s, e
    numbers = DIGITS.search(text) is not None
    if not numbers:
        return
    for m in IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):  # int() takes no long runs of digits
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by kind as in KINDS, then start; offsets are code points, the end exclusive. Base spans
    always stay; the added kinds stay if their score, with its context, is at least LEAST."""
    out = []
    for kind, s, e in confirmed(text or ""):
        score = SCORE[kind]
        if WORDS[kind].search(text, max(0, s - NEAR), s) or WORDS[kind].search(text, e, e + NEAR):
            score = min(1.0, score + BOOST)
        if kind in BASE or score >= LEAST:
            out.append(Span(kind, s, e, score))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id and spans (kind, start, end, score), as spans() gives them. Null texts have none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": x.kind, "start": x.start, "end": x.end, "score": x.score} for x in spans(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:int,end:int,score:double>>")
