"""Url templates against a plain recursive version, deep paths, planted branches."""

import random
import time
from collections import defaultdict

from shelfmark.llm import urls

RULES = (("block", "e.com/s/p"), ("allow", "e.com/ok/"), ("block", "bad.com/"), ("allow", "e.com/a/b/c/d/e/f/g/h/"))


def ruled(host, path):
    fits = [(len(text), text, verdict) for verdict, text in RULES if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0])) and path.startswith("/" + text.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    """page_id -> (verdict, template, purity)."""
    pages = []
    for page, url in rows:
        rest = url.partition("://")[2]
        host, slash, path = rest.partition("/")
        path = slash + path
        pages.append({"id": page, "host": host, "segs": [x for x in path.split("/") if x], "template": "", "label": ruled(host, path)[1]})

    def grow(group, depth):
        live = [p for p in group if len(p["segs"]) > depth]
        if not live:
            return
        count = lambda some: (len(some), sum(p["label"] == "block" for p in some), sum(p["label"] is not None for p in some))
        pn, pb, pm = count(live)
        by = defaultdict(list)
        for p in live:
            by[p["segs"][depth]].append(p)
        into = defaultdict(list)
        for seg, some in by.items():
            n, b, m = count(some)
            token = "*"
            if n >= 5 and (n >= 0.05 * pn or (m >= 5 and pn > pm)):
                token = seg
                if m >= 5:
                    token = "{=}"
                    if pm > m:
                        rate, rest, pool = b / m, (pb - b) / (pm - m), pb / pm
                        if (rate - rest) ** 2 > 3.8416 * (pool * (1 - pool) * (1 / m + 1 / (pm - m))):
                            token = "{+}" if rate > rest else "{-}"
            into[token] += some
        for token, some in into.items():
            for p in some:
                p["template"] += "/" + token
            grow(some, depth + 1)

    hosts = defaultdict(list)
    for p in pages:
        hosts[p["host"]].append(p)
    out = {}
    for group in hosts.values():
        grow(group, 0)
        at = defaultdict(list)
        for p in group:
            at[p["template"]].append(p)
        for template, some in at.items():
            b, m = sum(p["label"] == "block" for p in some), sum(p["label"] is not None for p in some)
            purity = (b + 2) / (m + 4)
            for p in some:
                out[p["id"]] = (p["label"] or ("block" if purity >= 0.9 and m >= 0.5 * len(some) else "allow"), template, round(purity, 9))
    return out


def judged(spark, rows):
    return {r.page_id: (r.verdict, r.template, round(r.purity, 9)) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}


def test_templates_of_any_depth_are_those_of_a_plain_version(spark):
    rng = random.Random(16)
    paths = ["/" + "/".join(rng.choice("abcdef")[: rng.randint(1, 1)] + ("" if rng.random() < 0.7 else str(rng.randint(0, 30))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    paths += ["/s/" + rng.choice("pq") + str(k) for k in range(60)] + ["/ok/x"] * 9 + ["/a/b/c/d/e/f/g/h/" + rng.choice("xyz") + str(k % 3) for k in range(60)] + ["/a/b/c/d/e/f/g/" + str(k) for k in range(20)]
    rows = [(k, f"http://{rng.choice(['e.com', 'www.e.com', 'x.bad.com'])}{p}") for k, p in enumerate(paths)]
    have, want = judged(spark, rows), brute(rows)
    assert have == want
    assert any(t.count("/") > 8 and "*" not in t.rsplit("/", 1)[0] for _, t, _ in want.values())


def test_a_planted_bad_branch_is_rejected_and_others_stay(spark):
    paths = [f"/s/p{k}" for k in range(40)] + [f"/s/q{k}" for k in range(5)] + [f"/t/q{k}" for k in range(40)] + [f"/ok/q{k}" for k in range(40)]
    out = judged(spark, [(k, f"http://e.com{p}") for k, p in enumerate(paths)])
    assert {p: out[k][0] for k, p in enumerate(paths)} == {p: "block" if p.startswith("/s/") else "allow" for p in paths}


def test_one_very_deep_path_costs_no_level_of_its_own(spark):
    rows = [(1, "http://e.com/" + "x/" * 5000), (2, "http://e.com/" + "x/" * 5000 + "y"), (3, "http://e.com/z")]
    began = time.time()
    out = judged(spark, rows)
    assert time.time() - began < 60 and out[1][1] == "/*" * 5000 and out[2][1] == "/*" * 5001 and out[3][1] == "/*"


def test_sql_twin_follows_deep_paths_and_rare_labelled_segments(spark, tmp_path):
    from ..compare import differ, duck

    rng = random.Random(12)
    rows = []
    for k in range(1500):
        host = rng.choice(("example.com", "a.example.com", "example.net", "x.org", "plain.io"))
        segs = [rng.choice(("de", "en", "fr", "p")) for _ in range(rng.choice((0, 1, 2)))] + [rng.choice("ab") for _ in range(rng.choice((0, 3, 12)))] + [str(rng.randrange(40))]
        rows.append((k, rng.choice((None, "no url", f"https://{host}/" + "/".join(segs))) if k % 50 == 0 else f"https://{host}/" + "/".join(segs)))
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert differ(urls.judge_urls(spark.read.parquet(f"{tmp_path}/pages.parquet")), duck(str(tmp_path)), urls.SQL) == ""
