"""Personal data against the plain patterns, with and without context, and on long runs."""

import hashlib
import random
import re
import time

import pytest

from shelfmark.llm import pii, queries

from .test_operators import DOC, ODD, docs_of

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checks(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), kind, m.end()) for kind, pattern in PLAIN.items() for m in pattern.finditer(text) if checks(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], [*PLAIN].index(s[1])))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "22", "333", "0", " ", "  ", "(", ")", "é", "_", "%", "4111111111111111", "10.0.0.1", "x@y.z", "\n", "256", "@@", ".."]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.find(text)[0] == brute(text), text


@pytest.mark.parametrize("run", ["7" * 1_000_000, "a" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "+1" + " " * 1_000_000, "AB12 " * 200_000, "AB12" + "C3" * 500_000, "1 " * 500_000, "(" * 1_000_000, "4111.1111/" * 100_000, "tel 12-34 " * 100_000, "a1b2" * 250_000, "10.0.0.1 " * 111_111])
def test_long_runs_take_time_in_proportion(run):
    def seconds(text):
        began = time.process_time()
        pii.find(text)
        return time.process_time() - began

    part = seconds(run[: len(run) // 4])
    assert seconds(run) < max(1.0, 8 * part)


@pytest.mark.parametrize(("kind", "span", "words", "against"), [
    ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", 'token = "{}"', 'commit token {}'),
    ("tel", "(030) 901820", "telephone {} or so", "serial phone {}"),
    ("account", "123456789", "passport {}", "order of passport {}"),
    ("payment", "4111.1111.1111.1111", "credit card {}", "isbn card {}"),
    ("iban", "DE89370400440532013000", "account {}", None),
])
def test_context_adjusts_the_score(kind, span, words, against):
    found = lambda text: [(k, text[a:b]) for a, k, b, _ in pii.find(text)[1]]
    score = lambda text: max((s[3] for s in pii.find(text)[1]), default=0.0)
    assert found(words.format(span)) == [(kind, span)]
    assert found(f"there is {span} here") == ([(kind, span)] if kind == "iban" else [])
    if against:
        assert score(against.format(span)) < pii.KEEP
    assert span not in pii.redact_text(words.format(span)) and f"<{kind.upper()}>" in pii.redact_text(words.format(span))


def test_failing_checks_are_no_spans():
    for text in ("credit card 4111.1111.1111.1112", "iban DE88370400440532013000", "token aaaaaaaaaaaaaaaaaaaaaaa", "token 123456789012345678901", "password correcthorsebatterystaple", "tel 12-34"):
        assert pii.find(text) == ([], [])


def test_query_against_brute_force_and_with_effect(spark, sf):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    more = 0
    for r in queries.op8_pii(spark, sf).collect():
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in PLAIN]
        told = [f"{k}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans) and len(spans) == r.n_spans
        more += r.n_spans - len(told)
    tokens = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t)) for t in docs.values())
    assert more >= tokens  # sf0.001 holds none


def test_odd_rows_and_empty_tables(spark):
    out = pii.pii_spans(docs_of(spark, ODD)).collect()
    assert sorted(((r.doc_id, r.n_spans) for r in out), key=repr) == sorted(((i, len(pii.find(t or "")[1])) for i, t in ODD), key=repr)
    none = spark.createDataFrame([], DOC)
    assert pii.pii_spans(none).count() == pii.redact(none).count() == 0
    assert sorted((r.text for r in pii.redact(docs_of(spark, ODD)).collect()), key=repr) == sorted((pii.redact_text(t) for _, t in ODD), key=repr)


def test_long_secrets_are_secrets_whatever_their_length(spark):
    rng = random.Random(9)
    rows = [(n, f'token = "{"".join(rng.choice("abcdefghjkmnp23456789QRSTUVWX") for _ in range(n))}" end') for n in (16, 250, 260, 5000)]
    out = {r.doc_id: r.spans for r in pii.pii_spans(docs_of(spark, rows)).collect()}
    assert all(f"secret:9:{9 + n}" in out[n].split(",") for n, _ in rows), out
