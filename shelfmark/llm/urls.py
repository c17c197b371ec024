"""Operator 3: URL filters. Rules first, then the labelled purity of path templates of each host."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf

#: The rules (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A segment stays apart if it has this share of its parent's urls, and as many urls; others are variable. Where
#: some of the parent's urls have no label, one with LABELLED labels stays apart whatever its share.
SHARE, SUPPORT = 0.05, 5
#: Labelled urls that a branch needs to be compared, and the squared z value (95 %) from which it differs.
LABELLED, Z2 = 5, 3.8416
#: Labelled urls that smoothing adds to each template, half of them blocked, and the purity that rejects it:
#: without labels of its own no template is rejected.
PRIOR, PURITY = 4.0, 0.9
#: Share of a template's urls that must be labelled before it rejects others.
KNOWN = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a list in the code, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        on, slash, rest = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """Extend each url's template by its segment at `depth`, once that is generalised and merged; `goes_on` says
    whether there may be more to tell apart below.

    A template of fewer than SUPPORT urls has no frequent segment at any depth: all that follows is variable.
    """
    at = rows.withColumn("seg", F.get("segs", F.lit(depth)))
    nodes = at.groupBy("host", "template", "seg").agg(F.count("*").alias("n"), F.sum("block").alias("b"), F.sum("labelled").alias("m"))
    parents = nodes.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.sum("m").alias("pm")).where(F.col("pn") >= SUPPORT)
    kept = nodes.where(F.col("n") >= SUPPORT).join(parents, ["host", "template"]).where((F.col("n") >= SHARE * F.col("pn")) | ((F.col("m") >= LABELLED) & (F.col("pn") > F.col("pm"))))
    rate, rest = F.col("b") / F.col("m"), (F.col("pb") - F.col("b")) / (F.col("pm") - F.col("m"))
    pool = F.col("pb") / F.col("pm")
    spread = pool * (1 - pool) * (1 / F.col("m") + 1 / (F.col("pm") - F.col("m")))
    apart = (F.col("pm") > F.col("m")) & ((rate - rest) * (rate - rest) > Z2 * spread)
    token = F.when(F.col("m") < LABELLED, F.col("seg")).when(F.when(F.col("pm") > F.col("m"), apart).otherwise(False), F.when(rate > rest, "{+}").otherwise("{-}")).otherwise("{=}")
    kept = kept.select("host", "template", "seg", token.alias("token"))
    out = at.join(kept, ["host", "template", "seg"], "left").join(parents.select("host", "template", F.lit(True).alias("many")), ["host", "template"], "left")
    left = F.size("segs") - depth
    longer = F.when(F.col("many"), F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*")))).otherwise(F.concat("template", F.repeat(F.lit("/*"), left)))
    return out.select(*(c for c in rows.columns if c not in ("template", "goes_on")), longer.alias("template"), (F.coalesce("many", F.lit(False)) & (left > 1)).alias("goes_on"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url, any more) -> page_id, host, path, rule, verdict, template, purity.

    Urls that a rule decides are the labelled ones. For each host a tree of path segments is grown
    level by level: rare segments become `*`; frequent ones with labels are merged with those
    siblings that the same test puts above, below or with the other siblings (`{+} {-} {=}`); frequent
    ones without labels stay. A template whose smoothed share of blocked urls reaches PURITY is blocked
    if KNOWN of its urls are labelled.

    All steps are sums by (host, template, segment) and joins with the few frequent segments; no host
    is gathered in one task. Levels go on as deep as SUPPORT urls share a template, whatever the length
    of paths; each writes only the urls that are told apart further. Null urls and those without `://`
    have an empty host and path and the empty template, repeated rows are judged alike, null page_ids
    stay null, other columns are never read, an empty table gives an empty result.
    """
    shelf = Shelf(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"))
    segs = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.select("*", segs.alias("segs"), F.lit("").alias("template"), F.coalesce((F.col("ruled") == "block").cast("int"), F.lit(0)).alias("block"), F.col("ruled").isNotNull().cast("int").alias("labelled"))
    rows = shelf.put(rows.withColumn("goes_on", F.size("segs") > 0), "level")
    done, depth = rows.where("NOT goes_on"), 0
    while not (rows := rows.where("goes_on")).isEmpty():
        rows = shelf.put(_level(rows, depth), f"level{depth}")
        done, depth = done.unionByName(rows.where("NOT goes_on")), depth + 1
    rows = done
    sums = rows.groupBy("host", "template").agg(F.sum("block").alias("tb"), F.sum("labelled").alias("tm"), F.count("*").alias("tn"))
    purity = (F.col("tb") + PRIOR / 2) / (F.col("tm") + PRIOR)
    rows = rows.join(sums.select("host", "template", purity.alias("purity"), (F.col("tm") >= KNOWN * F.col("tn")).alias("known")), ["host", "template"])
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when((F.col("purity") >= PURITY) & F.col("known"), "block").otherwise("allow")).alias("verdict"), "template", "purity")


#: The same, level by level, in a recursive query.
SQL = """WITH RECURSIVE u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u),
r AS (SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled, segs, '' AS template,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 ELSE 0 END AS block, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS labelled, CAST(0 AS BIGINT) AS depth, len(segs) > 0 AS goes_on FROM v
UNION ALL (WITH a AS (SELECT *, segs[depth + 1] AS seg FROM r WHERE goes_on),
    n AS (SELECT host, template, seg, count(*) AS n, sum(block) AS b, sum(labelled) AS m FROM a GROUP BY ALL),
    p AS (SELECT host, template, sum(n) AS pn, sum(b) AS pb, sum(m) AS pm FROM n GROUP BY ALL HAVING sum(n) >= 5),
    k AS (SELECT n.host, n.template, n.seg, CASE WHEN m < 5 THEN n.seg
        WHEN pm > m AND (b / m - (pb - b) / (pm - m)) ** 2 > 3.8416 * (pb / pm * (1 - pb / pm) * (1 / m + 1 / (pm - m))) THEN CASE WHEN b / m > (pb - b) / (pm - m) THEN '{+}' ELSE '{-}' END
        ELSE '{=}' END AS token FROM n JOIN p ON n.host = p.host AND n.template = p.template WHERE n >= 5 AND (n >= 0.05 * pn OR (m >= 5 AND pn > pm)))
    SELECT a.page_id, a.host, a.path, a.rule, a.ruled, a.segs, CASE WHEN p.pn IS NULL THEN a.template || repeat('/*', len(a.segs) - a.depth) ELSE a.template || '/' || coalesce(k.token, '*') END, a.block, a.labelled, a.depth + 1, p.pn IS NOT NULL AND len(a.segs) - a.depth > 1
    FROM a LEFT JOIN p ON a.host = p.host AND a.template = p.template LEFT JOIN k ON a.host = k.host AND a.template = k.template AND a.seg = k.seg)),
e AS (SELECT * FROM r WHERE NOT goes_on),
s AS (SELECT host, template, (sum(block) + 2.0::DOUBLE) / (sum(labelled) + 4.0::DOUBLE) AS purity, sum(labelled) >= 0.5 * count(*) AS known FROM e GROUP BY host, template)
SELECT e.page_id, e.host, e.path, e.rule, coalesce(e.ruled, CASE WHEN s.purity >= 0.9 AND s.known THEN 'block' ELSE 'allow' END) AS verdict, e.template, s.purity
FROM e JOIN s ON e.host = s.host AND e.template = s.template"""
