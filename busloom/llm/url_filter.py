"""URL filter by a path-template tree per host, learned from labelled pages; DataFrame operations only.

A path is a list of segments.  Digits in a segment become ``#`` and long hexadecimal names ``{hex}``.  Then
the tree of each host is built from the root down, one level at a time.  A child becomes the
wildcard ``*``

* if none of its pages is labelled, or
* if its good labels do not differ from the whole node's share by more than chance (statistically similar
  branches merge).  Up to ``EXACT`` labelled pages that is the exact binomial test, so the few pages of
  a variable segment (slugs, user names) prove nothing; beyond, its normal approximation.

A node whose labelled pages are all good or all bad, or that holds one shape only, can't be split further
down, so the rest of its paths is ``*`` at once; the tree ends at the deepest node that can.  Segments that all
pages of a new node share are wildcards too (an only child is like its node) and are passed in one step, up to the
end of the shortest path.

What is left are templates such as ``shop.example/*/#.html``.  A template whose share of good
labels, smoothed towards its host's and that towards all hosts', is below one half is rejected.

Every level is two aggregates with map-side combining over distinct shapes and a join back, so a
host with a third of all pages is no one's single task.  Explicit rules come first (longest wins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once

CHANCE = 0.01  # two-sided
SPREAD = 2.576  # standard errors of the same chance
EXACT = 1000  # labelled pages; 0.5 ** 1000 is still a double
SMOOTHING = 20.0
LEAST_PURITY = 0.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``host/path`` to verdict) that fits, and its verdict; nulls if none does.

    A rule fits its host and all subdomains where the path starts with the rule's.  The rules are
    settings, written out as one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """Segments with digits and long hexadecimal names generalised, however many."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    return F.transform(segments, lambda s: F.when(
        s.rlike("^[0-9a-f-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-f-]"), "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "#")))


COUNTS = ("pages", "labelled", "good")


def _summed(df: DataFrame, *keys: str, counts: tuple[str, ...] = COUNTS) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def _differs(good: Column, labelled: Column, share: Column) -> Column:
    """Whether so many of the labelled being good is less likely than ``CHANCE`` at this share (strictly between 0 and 1)."""
    # The rarer label is counted, so the first probability can't underflow.
    rare = F.least(share, 1 - share)
    hits = F.when(share > 0.5, labelled - good).otherwise(good)
    none = F.array().cast("array<bigint>")
    first = F.pow(1 - rare, labelled)
    below = F.aggregate(
        F.when(hits > 0, F.sequence(F.lit(1).cast("bigint"), hits)).otherwise(none), F.struct(first.alias("one"), first.alias("sum")),
        lambda a, k: F.struct((a["one"] * (labelled - k + 1) / k * rare / (1 - rare)).alias("one"),
                              (a["sum"] + a["one"] * (labelled - k + 1) / k * rare / (1 - rare)).alias("sum")),
        lambda a: 2 * F.least(a["sum"], 1 - a["sum"] + a["one"]))
    return F.when(labelled <= EXACT, below < CHANCE).otherwise(F.abs(good / labelled - share) > SPREAD * F.sqrt(share * (1 - share) / labelled))


def _common(low: Column, high: Column) -> Column:
    """Length of the common start of two lists: of all lists, if these are the least and the greatest."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(low), F.size(high))).cast("int")


def templates(shaped: DataFrame) -> DataFrame:
    """host, shapes, template for distinct (host, shapes) with their counts of pages, labelled and good ones."""
    counts, columns = (*COUNTS, "rows"), ("host", "shapes", *COUNTS, "template")
    state, done = shaped.withColumns({"template": F.lit(""), "level": F.lit(0), "open": F.size("shapes") > 0}), []
    while True:
        done.append(state.where("NOT open").select(*columns))
        state = state.where("open")
        if state.isEmpty():
            return reduce(DataFrame.unionAll, done)
        state = state.withColumns({"segment": F.expr("element_at(shapes, level + 1)"), "rows": F.lit(1)})
        after = F.expr("slice(shapes, level + 2, size(shapes))")
        child = state.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in counts), F.min(after).alias("low"), F.max(after).alias("high"))
        node = _summed(child, "host", "template", counts=counts).withColumnsRenamed({c: f"all_{c}" for c in counts})
        splits = (F.col("all_good") > 0) & (F.col("all_good") < F.col("all_labelled")) & (F.col("all_rows") > 1)
        apart = (F.col("labelled") > 0) & _differs(F.col("good"), F.col("labelled"), F.col("all_good") / F.col("all_labelled"))
        branch = child.join(node, ["host", "template"]).select(
            "host", "template", "segment", splits.alias("splits"), F.when(splits & apart, F.col("segment")).otherwise("*").alias("branch"), "low", "high")
        chains = branch.where("splits").groupBy("host", "template", "branch").agg(_common(F.min("low"), F.max("high")).alias("chain"))
        branch = branch.drop("low", "high").join(chains, ["host", "template", "branch"], "left")
        level = F.col("level") + 1 + F.coalesce("chain", F.lit(0))
        stars = F.repeat(F.lit("/*"), F.when(F.col("splits"), F.col("chain")).otherwise(F.size("shapes") - F.col("level") - 1))
        state = written_once(
            state.join(branch, ["host", "template", "segment"]).select(
                *columns[:-1], F.concat("template", F.lit("/"), "branch", stars).alias("template"), level.alias("level"),
                (F.col("splits") & (F.size("shapes") > level)).alias("open")),
            "templates")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of ``pages`` (page_id, url).

    ``labels``: page_id and good (1 or 0); a page labelled both ways, or with anything else, counts as
    unlabelled.  A null url or one without ``://`` has an empty host and path and is judged by
    the template of the empty host.  Repeated rows are judged each and count each; a null page_id
    is never labelled.  Without any label every template passes.  Other columns are ignored; an
    empty table gives no rows.  Intermediates are written while the frame is built.
    """
    host, path = split_url(F.col("url").cast("string"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shapes(F.col("path")).alias("shapes"))
    clear = labels.where("good IN (0, 1)").groupBy("page_id").agg(F.min("good").alias("good"), F.max("good").alias("_most")).where("good = _most")
    urls = written_once(urls.join(clear.select("page_id", "good"), "page_id", "left"), "urls")
    shaped = written_once(urls.groupBy("host", "shapes").agg(
        F.count("*").alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")), "shapes")
    named = templates(shaped)
    overall = shaped.agg(F.try_divide(F.sum("good"), F.sum("labelled")).alias("share"))
    hosts = _summed(shaped, "host").crossJoin(F.broadcast(overall)).select(  # one row
        "host", ((F.col("good") + SMOOTHING * F.coalesce("share", F.lit(1.0))) / (F.col("labelled") + SMOOTHING)).alias("share"))
    purity = (F.col("good") + SMOOTHING * F.col("share")) / (F.col("labelled") + SMOOTHING)
    judged = _summed(named, "host", "template").join(hosts, "host").select(
        "host", "template", F.when(purity < LEAST_PURITY, "block").otherwise("allow").alias("learned"))
    by_shape = named.select("host", "shapes", "template").join(judged, ["host", "template"])
    return urls.join(by_shape, ["host", "shapes"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), F.concat("host", "template").alias("template"))


def judge_sql(rules: dict[str, str]) -> str:
    """The same in DuckDB's SQL over ``pages`` and ``labels`` (good: quality), level by level to the last segment."""
    def case(wanted) -> str:
        arms = []
        for text in sorted(rules, key=lambda r: (-len(r), r)):
            domain, slash, start = text.partition("/")
            arms.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{start}') THEN {wanted(text)}")
        return f"CASE {' '.join(arms)} END"

    shape = ("CASE WHEN regexp_matches(s, '^[0-9a-f-]{8,}$') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-f-]') "
             "THEN '{hex}' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END")
    rarer = "lambda k: exp(lgamma(l + 1) - lgamma(k + 1) - lgamma(l - k + 1) + k * ln(s) + (l - k) * ln(1 - s))"
    return f"""
WITH RECURSIVE rest AS (
  SELECT page_id, COALESCE(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
clear AS (
  SELECT doc_id, MIN(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING MIN(quality) = MAX(quality)),
urls AS (
  SELECT page_id, host, path, {case(lambda t: f"'{t}'")} AS rule, {case(lambda t: f"'{rules[t]}'")} AS ruled, good,
         list_transform(string_split(path, '/')[2:], lambda s: {shape}) AS shapes
  FROM parts LEFT JOIN clear ON doc_id = page_id),
shaped AS (
  SELECT host, shapes, COUNT(good) AS labelled, COALESCE(SUM(good), 0) AS good FROM urls GROUP BY host, shapes),
state AS (
  SELECT host, shapes, CAST(labelled AS BIGINT) AS labelled, CAST(good AS BIGINT) AS good, '' AS template, 0 AS level FROM shaped
  UNION ALL
  SELECT host, shapes, labelled, good, template || '/' || CASE
           WHEN l = 0 OR s <= 0 OR s >= 1 THEN '*'
           WHEN l > {EXACT} THEN CASE WHEN abs(g / l - s) > {SPREAD} * sqrt(s * (1 - s) / l) THEN segment ELSE '*' END
           WHEN 2 * LEAST(list_sum(list_transform(range(0, g + 1), {rarer})), list_sum(list_transform(range(g, l + 1), {rarer}))) < {CHANCE} THEN segment
           ELSE '*' END, level + 1
  FROM (SELECT *, CAST(SUM(labelled) OVER child AS BIGINT) AS l, CAST(SUM(good) OVER child AS BIGINT) AS g,
               SUM(good) OVER node / GREATEST(SUM(labelled) OVER node, 1) AS s
        FROM (SELECT *, shapes[level + 1] AS segment FROM state WHERE len(shapes) > level)
        WINDOW child AS (PARTITION BY host, template, segment), node AS (PARTITION BY host, template))),
ended AS (SELECT * FROM state WHERE level = len(shapes)),
hosts AS (
  SELECT host, (SUM(good) + {SMOOTHING} * COALESCE((SELECT SUM(good) / SUM(labelled) FROM shaped), 1.0)) / (SUM(labelled) + {SMOOTHING}) AS share FROM shaped GROUP BY host),
judged AS (
  SELECT t.host, t.template, CASE WHEN (SUM(good) + {SMOOTHING} * ANY_VALUE(share)) / (SUM(labelled) + {SMOOTHING}) < {LEAST_PURITY} THEN 'block' ELSE 'allow' END AS learned
  FROM ended t JOIN hosts h ON t.host = h.host GROUP BY t.host, t.template)
SELECT u.page_id, u.host, u.path, u.rule, COALESCE(u.ruled, j.learned) AS verdict, u.host || t.template AS template
FROM urls u JOIN ended t ON u.host = t.host AND u.shapes = t.shapes JOIN judged j ON t.host = j.host AND t.template = j.template"""
