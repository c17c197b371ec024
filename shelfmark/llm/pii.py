"""Operator 8: personal data. Regular expressions propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces, small_batches

#: Order of kinds among spans with one start: the base ones, then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "payment", "tel", "account", "secret")
#: The base patterns. An email is found from its `@`, and an address only where a run of digits
#: begins, which are the places where the plain patterns match, without their tries at every other place.
EMAIL_NAME = string.ascii_letters + string.digits + "._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The method's own: an account number in international form; card numbers whose groups stand apart otherwise than
#: the base allows; digits that only context makes a phone or an account number; long mixed words that it makes a secret.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
PAYMENT = re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{4,6}+(?:[\x20\xA0./_-]{1,3}+[0-9]{2,6}+){2,4}(?![A-Za-z0-9])")
TEL = re.compile(r"(?<![A-Za-z0-9.+-])\(?+[0-9]++(?:[\x20()./-]{1,2}+[0-9]++){1,6}+(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9.+-])[0-9](?:[\x20-]?[0-9]){5,11}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
LETTER = re.compile("[A-Za-z]")
DIGIT = re.compile("[0-9]")
#: Words near a span (either side) that make its reading likelier, and those that make it less likely.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "payment": ("card", "visa", "credit", "debit", "payment"),
    "tel": ("phone", "telephone", "tel", "mobile", "fax"),
    "account": ("ssn", "passport", "account", "insurance", "social"),
    "secret": ("token", "secret", "password", "passwd", "apikey", "bearer", "credential", "credentials"),
}
AGAINST = {
    "ip": ("version", "release", "section"),
    "payment": ("isbn", "order", "serial"),
    "tel": ("isbn", "order", "serial", "version"),
    "account": ("isbn", "order", "serial", "version"),
    "secret": ("sha", "commit", "checksum", "digest", "revision"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "payment": 0.35, "tel": 0.2, "account": 0.2, "secret": 0.3}
CONTEXT_GAIN, CONTEXT_LOSS = 0.4, 0.3
KEEP = 0.5
WINDOW = 40
#: Characters of a secret, and different ones among them, at least.
SECRET_LENGTH, SECRET_VARIETY = 16, 8
MASK = {k: f"<{k.upper()}>" for k in KINDS}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, top_score double"


def luhn(digits: str) -> bool:
    """Sum of digits, every second from the right doubled and reduced, is divisible by ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits go to the end, letters count from 10: the number is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the emails: the name before each `@` as far back as it goes, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(EMAIL_NAME))
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four base kinds; matches that fail their check are dropped without a retry."""
    found = [(start, "email", end) for start, end in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the account numbers whose check holds.

    The pattern takes words and numbers that follow with a number, so that of each match all ends at
    blanks are tried, the longest first. The search goes on behind what was found, or if no end
    holds, behind the match's first blank.
    """
    at = 0
    while m := IBAN.search(text, at):
        start, end = m.span()
        while end > start and not (15 <= len(account := text[start:end].replace(" ", "")) <= 34 and mod97(account)):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        at = end if end > start else text.find(" ", start, m.end()) if " " in m[0] else m.end()


def adjusted(text: str, start: int, end: int, kind: str) -> float:
    """A span's score: its kind's prior, more with a word of its context near, less with one against it."""
    around = set(re.split(r"[^a-z]+", f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW]}".lower()))
    gain = CONTEXT_GAIN * (not around.isdisjoint(CONTEXT[kind])) - CONTEXT_LOSS * (not around.isdisjoint(AGAINST.get(kind, ())))
    return min(1.0, max(0.0, PRIOR[kind] + gain))


class Taken:
    """Disjoint spans, in order: whether another one overlaps any takes a search by halves."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k < 0 or self.ends[k] <= start

    def plus(self, spans: list[tuple[int, int]]) -> Taken:
        return Taken([*zip(self.starts, self.ends), *spans]) if spans else self


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def secret_like(word: str) -> bool:
    """Letters and digits mixed, of many kinds: a word or a number alone is no secret."""
    return len(word) >= SECRET_LENGTH and DIGIT.search(word) is not None and LETTER.search(word) is not None and len(set(word)) >= SECRET_VARIETY


def own_candidates(text: str) -> Iterator[tuple[str, Iterator[tuple[int, int]]]]:
    """The method's kinds in order of precedence, with (start, end) of what their patterns and checks let pass."""
    yield "iban", ibans(text)
    yield "payment", (m.span() for m in PAYMENT.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d))
    yield "tel", (m.span() for m in TEL.finditer(text) if 7 <= sum(c in string.digits for c in m[0]) <= 15)
    yield "account", (m.span() for m in ACCOUNT.finditer(text))
    yield "secret", (m.span() for m in SECRET.finditer(text) if secret_like(m[0]))


def find(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, float]]]:
    """The base spans, and all spans with scores: base ones whatever their score, others from KEEP on if they overlap
    none of an earlier kind."""
    base = base_spans(text)
    scored = [(start, kind, end, adjusted(text, start, end, kind)) for start, kind, end in base]
    if DIGIT.search(text):
        taken = Taken([(s, e) for s, _, e in base])
        for kind, spans in own_candidates(text):
            kept = [(start, kind, end, score) for start, end in spans if taken.free(start, end) and (score := adjusted(text, start, end, kind)) >= KEEP]
            scored += kept
            taken = taken.plus([(s, e) for s, _, e, _ in kept])
    rank = lambda s: (s[0], KINDS.index(s[1]), s[2])
    return sorted(base, key=rank), sorted(scored, key=rank)


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, *_ in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "top_score")}
        for text in batch.column("text").to_pylist():
            base, spans = find(text or "")
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[1] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_spans"].append(len(spans))
            out["top_score"].append(max((s[3] for s in spans), default=0.0))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})


def pii_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> a row for each document: counts and digest of the base kinds, and all spans.

    Positions are code points, ends exclusive. Null texts count as empty. No row depends on another:
    a plain map over the scan without a shuffle, repeated and tied rows are treated alike, null doc_ids
    stay null, other columns are never read, an empty table gives an empty one. A text is read whole.
    Each pattern begins at most once for a run of letters or digits and doesn't turn back over it, so
    that the cost is in proportion to the text's length.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_report, SCHEMA)


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind's mask; of overlapping spans the first, or longest, counts."""
    if text is None:
        return None
    parts, at = [], 0
    for start, kind, end, _ in sorted(find(text)[1], key=lambda s: (s[0], -s[2])):
        if start >= at:
            parts += [text[at:start], MASK[kind]]
            at = end
        elif end > at:
            at = end
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in `text` (and n_chars as it then is); all other columns and rows stay.

    Null and empty texts stay as they are, equal rows give equal rows, an empty table gives an empty one;
    n_chars is written only where the text changed. Further columns may have any name.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [redact_text(t) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array([n if t == o else len(t) for t, o, n in zip(texts, batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
