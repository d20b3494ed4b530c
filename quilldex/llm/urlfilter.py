"""URL filter: rules for hosts and paths, and trust that spreads over links between hosts.

Personalised PageRank spreads trust from hosts whose pages rules allow along links, and
distrust from hosts whose pages rules block against links (who links to blocked hosts is
suspect). Both start from the share of a host's pages and are scaled so that a host
without links keeps its share; a host is blocked where distrust outweighs trust by the
threshold. Rules decide first, the longest that fits; the graph decides the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

#: (verdict, host, path from its slash on)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Ranks spread until no host gets more than TOLERANCE in a round.
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of absolute and protocol-relative links; a page's <base> is one, which its relative links go to.
LINK = r"(?i)href\s{0,9}=\s{0,9}[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match(rules, pick) -> Column:
    """pick(rule) of the longest rule that fits host and path, else null."""
    cases = []
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
        cases.append(F.when(fits, F.lit(pick(rule))))
    return F.coalesce(*cases)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and the rule's verdict (null where none fits)."""
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parsed.withColumns({"rule": match(rules, lambda r: r[1] + r[2]), "by_rule": match(rules, lambda r: r[0])})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of a host that link to another one, counted once a page; a host's own don't count.

    Links without a host go to the page's own, or to that of its <base>, which counts as a link itself.
    """
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    pairs = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(links).alias("dst")).filter("src != dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, work: Work, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` of the same columns over ``edges`` (src, dst, n).

    rank = seed + damping * sum(rank of neighbours * share of the link), trust along links and
    distrust against them, as one edge table with a kind. A round sends on what the last one
    brought: one join on the sending host and one sum, written to the shared folder. What is
    sent shrinks by ``damping`` a round, and rounds end when no host gets more than ``tolerance``.
    """
    out_n = edges.groupBy("src").agg(F.sum("n").alias("all"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    ahead = edges.join(out_n, "src").select(F.lit(0).alias("kind"), F.col("src").alias("sender"), F.col("dst").alias("host"), (F.col("n") / F.col("all")).alias("w"))
    back = edges.join(in_n, "dst").select(F.lit(1).alias("kind"), F.col("dst").alias("sender"), F.col("src").alias("host"), (F.col("n") / F.col("all")).alias("w"))
    both = work.keep(ahead.union(back), "edges")
    start = work.keep(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("v")))).alias("x")).select("host", "x.kind", "x.v").filter("v > 0"), "seeds")
    rank = new = start
    while True:
        sent = both.join(new.withColumnRenamed("host", "sender"), ["kind", "sender"])
        new = work.keep(sent.groupBy("kind", "host").agg(F.sum(F.col("v") * F.col("w") * damping).alias("v")), "sent")
        if (new.agg(F.max("v")).first()[0] or 0) <= tolerance:
            break
        rank = work.keep(rank.unionByName(new).groupBy("kind", "host").agg(F.sum("v").alias("v")), "rank")
    return rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v"))), F.lit(0.0)).alias(name) for k, name in ((0, "trust"), (1, "distrust"))])


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of ``pages`` (page_id, url, html).

    A url that is null or lacks ``://`` has empty host and path: no rule fits and no links
    count, so it is allowed. A null html has no links; a very long one is searched whole.
    Repeated rows count in their host's shares. Hosts beyond the graph have trust and distrust
    0 and are allowed. Of rules of equal length the first listed wins. No rows give no rows;
    other columns, whatever their names, don't matter.
    """
    work = Work(pages.sparkSession, "urls")
    ruled = with_rules(pages.select("page_id", "url", "html"), rules)
    share = lambda verdict: F.avg(F.coalesce((F.col("by_rule") == verdict).cast("double"), F.lit(0.0)))
    seeds = work.keep(ruled.filter(F.col("host") != "").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    edges = work.keep(host_edges(ruled), "links")
    ranks = seeds if edges.isEmpty() else propagate(edges, seeds, work)
    # written, so that Spark knows its size and broadcasts it only below its threshold
    ranks = work.keep(ranks.withColumnRenamed("host", "of"), "ranks")
    found = ruled.drop("html").join(ranks, F.col("host") == F.col("of"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    by_graph = F.when(distrust - trust >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle(rules=RULES, damping: float = DAMPING, rounds: int = 100, threshold: float = THRESHOLD) -> str:
    """The same in SQL; a hundred rounds leave less than the tolerance."""
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2]}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in ordered) + " END"
    return rf"""
WITH RECURSIVE rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM parsed),
seeds AS (
  SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
found AS (
  SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s{{0,9}}=\s{{0,9}}["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS dst
  FROM ruled WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst GROUP BY src, dst),
edges AS (
  SELECT 0 AS kind, src AS sender, dst AS host, n / sum(n) OVER (PARTITION BY src) AS w FROM links
  UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
r0 AS (SELECT 0 AS kind, host, trust AS v FROM seeds WHERE trust > 0 UNION ALL SELECT 1, host, distrust FROM seeds WHERE distrust > 0),
sent AS (
  SELECT 0 AS k, kind, host, v FROM r0
  UNION ALL
  SELECT k + 1, e.kind, e.host, sum(s.v * e.w * {damping}) FROM sent s JOIN edges e ON e.kind = s.kind AND e.sender = s.host WHERE k < {rounds} GROUP BY k, e.kind, e.host),
ranks AS (SELECT host, sum(v) FILTER (kind = 0) AS trust, sum(v) FILTER (kind = 1) AS distrust FROM sent GROUP BY host)
SELECT page_id, p.host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled p LEFT JOIN ranks r ON r.host = p.host
"""
