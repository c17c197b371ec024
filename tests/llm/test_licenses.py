"""Licence scans against plain searches, with whole licence texts and many repeats."""

import random
import re
import time

from shelfmark.llm import licenses, queries

from .test_operators import DOC, ODD, docs_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_of_every_document(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_license_scans(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics_are_longest_runs_of_any_template():
    rng = random.Random(14)
    for _ in range(60):
        texts = [[rng.randint(0, 4) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        runs = {(tuple(t[a:b])): {k for k, u in enumerate(texts) if any(u[c : c + b - a] == t[a:b] for c in range(len(u)))} for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        tool = licenses.Automaton(texts)
        words = [rng.randint(0, 5) for _ in range(40)]
        for i, (length, state) in enumerate(tool.statistics(words)):
            assert length == max((n for n in range(i + 2) if n == 0 or tuple(words[i + 1 - n : i + 1]) in runs), default=0)
            assert length == 0 or tool.owners[state] == runs[tuple(words[i + 1 - length : i + 1])]


def test_best_spans_are_those_that_no_larger_one_meets():
    rng = random.Random(15)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9), rng.choice("xyz"), rng.randint(1, 5)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        want = {s for s in spans if not any(o[3] > s[3] and o[0] < s[1] and s[0] < o[1] for o in spans)}
        assert sorted(licenses._best(spans)) == sorted(want)


def test_whole_texts_short_notices_and_identifiers(spark):
    rows = [(k, f"foo bar {text} baz") for k, (_, text) in enumerate(licenses.templates())]
    out = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, rows)).collect()}
    for k, (label, text) in enumerate(licenses.templates()):
        spans = [s.split(":") for s in out[k].spans.split(",")]
        assert label in out[k].labels.split(",") and [label, "2", str(2 + len(words_of(text)))] in spans, text
    assert set(out[len(licenses.TEXTS) - 10].labels.split(",")) == {"mit"} and "isc" not in out[6].labels


def test_time_is_in_proportion_to_the_number_of_notices(spark):
    notice = dict(licenses.TEXTS)["apache"] + " x y z u v w. "
    tool = licenses.scanner()

    def seconds(n):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [notice * n]})
        began = time.process_time()
        rows = [*licenses._scan(iter([batch]))][0].to_pylist()[0]
        assert rows["spans"].count("apache:") == n and rows["labels"] == "apache"
        return time.process_time() - began

    assert tool and seconds(4000) < 8 * max(seconds(1000), 0.2)


def test_odd_rows_and_empty_tables(spark):
    out = licenses.license_scan(docs_of(spark, ODD)).collect()
    assert sorted(((r.doc_id, r.n_words) for r in out), key=repr) == sorted(((i, len(words_of(t))) for i, t in ODD), key=repr)
    assert licenses.license_scan(spark.createDataFrame([], DOC)).count() == 0


def test_phrases_of_licences_in_other_prose_give_no_label(spark):
    prose = [
        "Distributed under the terms of the agreement between both parties.",
        "Our services, including but not limited to the following items",
        "You may obtain a copy of the minutes",
        "As required by applicable law or agreed to in writing by the tenants",
        "In no event will the committee pay. It is distributed in the hope that it helps.",
        dict(licenses.TEXTS)["mit"].split("THE SOFTWARE IS PROVIDED")[1],
        " ".join(reversed(re.findall(r"\S+ \S+ \S+ \S+ \S+ \S+", dict(licenses.TEXTS)["apache"]))),
    ]
    out = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, [*enumerate(prose)])).collect()}
    assert all((out[k].labels, out[k].spans, out[k].score) == ("", "", 0.0) for k in range(len(prose) - 1)), out
    assert out[len(prose) - 1].spans == ""


def test_a_text_with_words_left_out_or_put_in_keeps_its_label(spark):
    words = dict(licenses.TEXTS)["apache"].split()
    rows = [(1, " ".join(w for k, w in enumerate(words) if k % 17 != 11)), (2, " ".join(w + " really" * (k % 13 == 5) for k, w in enumerate(words))), (3, " ".join(words[: len(words) // 2]))]
    out = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, rows)).collect()}
    assert out[1].spans.startswith("apache:") and out[2].spans == f"apache:0:{out[2].n_words}" and out[3].spans == ""


def test_places_are_where_runs_end_in_the_templates():
    rng = random.Random(16)
    for _ in range(40):
        texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        tool = licenses.Automaton(texts)
        words = [rng.randint(0, 3) for _ in range(30)]
        for i, (length, state) in enumerate(tool.statistics(words)):
            run = words[i + 1 - length : i + 1]
            assert not length or tool.places[state] == {k: ends for k, t in enumerate(texts) if (ends := [e for e in range(length, len(t) + 1) if t[e - length : e] == run])}
