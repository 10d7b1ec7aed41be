"""URL filters: rules by host and path, and trust carried over the links between hosts.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's; of the rules that
fit, the longest decides. Pages without a rule go by their host: personalised PageRank carries trust from hosts whose pages
rules allow along links, and distrust from hosts whose pages rules block against the links. Beside either score runs
that of a walk from all hosts, and what counts is the share of the one in the other, so that neither a host's size nor how
many others link like it matter: a host's trust is the share of what comes to it over links that began on allowed pages, its
distrust the share of the steps of walks from it that end on blocked pages. The shares of its own pages that rules
allow or block are added. A host is blocked if its distrust exceeds its trust by more than a threshold; a host without links
has its own pages' shares alone.

Only DataFrame operations are used. Links are aggregated to weighted host edges before any join, hosts are joined to
pages last, and a round's result is written to the shared folder, so that lineage ends there. What a host got in a round
is all that it passes on in the next, and what is no more than a tolerance isn't passed on; rounds end when nothing is,
which damping sees to.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged as the host ''. Links of a
host to itself, relative links and links without a host say nothing. A null html has no links. Repeated rows are judged
alike, row by row. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.shared import read_table, settled, taken

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
TOLERANCE = 1e-4
#: Scores are rounded to so many places before they are compared with the threshold.
PLACES = 4
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)(?:href|src)\s*=\s*[\x22\x27]?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^/?#\x22\x27<>\s]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def by_rule(rules: tuple[tuple[str, str, str], ...], value: int) -> Column:
    """The rule's text (value 0) or verdict (1) of the longest rule that fits columns host and path; null if none does."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit((host + path, verdict)[value])).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """source, target, weight: links between different hosts. pages has a column host."""
    found = pages.select("host", F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("link"))
    found = found.select(F.col("host").alias("source"), F.translate(F.regexp_extract("link", r"//(.*)$", 1), UPPER, LOWER).alias("target"))
    return found.where("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def host_scores(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from hosts (host, allowed, blocked: shares of its pages) and host edges."""
    edges = settled(edges, "edges")
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    links = edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("part"))
    forth = links.select(F.lit("trust").alias("kind"), F.col("source").alias("origin"), F.col("target").alias("host"), "part")
    back = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("origin"), F.col("source").alias("host"), "part")
    moves = settled(forth.unionByName(back), "moves")
    zero = F.lit(0.0)
    linked = links.select(F.col("source").alias("host")).union(links.select("target")).select("host", zero.alias("allowed"), zero.alias("blocked"))
    seeds = settled(hosts.unionByName(linked).groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")), "seeds")
    begin = lambda kind, share: seeds.select(F.lit(kind).alias("kind"), "host", zero.alias("score"), zero.alias("mass"), F.col(share).alias("fresh"), F.lit(1.0).alias("flow"))
    state = begin("trust", "allowed").unionByName(begin("distrust", "blocked"))
    # score and mass are what came over links, fresh and flow what came last: all that is passed on.
    while not moves.isEmpty() and not state.where(F.col("flow") > tolerance).isEmpty():
        passing = state.where(F.col("flow") > tolerance).select("kind", F.col("host").alias("origin"), "fresh", "flow")
        sent = moves.join(passing, ["kind", "origin"]).select("kind", "host", zero.alias("score"), zero.alias("mass"), (F.col("part") * F.col("fresh") * damping).alias("fresh"), (F.col("part") * F.col("flow") * damping).alias("flow"))
        both = state.select("kind", "host", "score", "mass", zero.alias("fresh"), zero.alias("flow")).unionByName(sent)
        state = settled(both.groupBy("kind", "host").agg((F.sum("score") + F.sum("fresh")).alias("score"), (F.sum("mass") + F.sum("flow")).alias("mass"), F.sum("fresh").alias("fresh"), F.sum("flow").alias("flow")), "state")
    share = lambda kind: F.sum(F.when((F.col("kind") == kind) & (F.col("mass") > 0), F.col("score") / F.col("mass")).otherwise(0.0))
    carried = state.groupBy("host").agg(share("trust").alias("trust"), share("distrust").alias("distrust"))
    scores = seeds.join(carried, "host").select("host", (F.col("allowed") + F.col("trust")).alias("trust"), (F.col("blocked") + F.col("distrust")).alias("distrust"))
    return settled(scores, "scores")  # a side of its own, so that a host of many pages can be split in a join


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust for each row of pages."""
    pages = taken(pages, **{id: id, "url": url, "html": html})
    parted = pages.select(id, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parted.select(id, "host", "path", by_rule(rules, 0).alias("rule"), by_rule(rules, 1).alias("ruled"))
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    hosts = ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    edges = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    scores = host_scores(hosts, edges, damping, tolerance).withColumnRenamed("host", "scored")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = ruled.join(scores, F.col("host") == F.col("scored"), "left").select(id, "host", "path", "rule", "ruled", zero("trust").alias("trust"), zero("distrust").alias("distrust"))
    own = F.when(F.round(F.col("distrust") - F.col("trust"), PLACES) > threshold, "block").otherwise("allow")
    return joined.select(id, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    chosen = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = ("CASE" + cases.format(*x) + " END" for x in ([h + p for h, p, _ in chosen], [v for *_, v in chosen]))
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages
), r AS (
  SELECT *, {rule} AS rule, {verdict} AS ruled FROM p
), h AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM r GROUP BY host
), l AS (
  SELECT host AS source, translate(regexp_extract(link, '//(.*)$', 1), '{UPPER}', '{LOWER}') AS target FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK}', 1)) AS link FROM p)
), e AS (
  SELECT source, target, count(*) AS weight FROM l WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
), n AS (
  SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS part FROM e
), m AS (
  SELECT 'trust' AS kind, source AS origin, target AS host, part FROM n UNION ALL SELECT 'distrust', target, source, part FROM n
), o AS (
  SELECT host, max(allowed)::DOUBLE AS allowed, max(blocked)::DOUBLE AS blocked
  FROM (SELECT * FROM h UNION ALL SELECT source, 0, 0 FROM e UNION ALL SELECT target, 0, 0 FROM e) GROUP BY host
), z AS (
  SELECT kind, host, fresh, 1.0::DOUBLE AS flow, 0 AS k FROM (SELECT 'trust' AS kind, host, allowed AS fresh FROM o UNION ALL SELECT 'distrust', host, blocked FROM o)
  UNION ALL SELECT m.kind, m.host, sum(m.part * z.fresh) * {DAMPING}, sum(m.part * z.flow) * {DAMPING}, z.k + 1
    FROM z JOIN m ON m.kind = z.kind AND m.origin = z.host WHERE z.flow > {TOLERANCE} GROUP BY m.kind, m.host, z.k
), c AS (
  SELECT kind, host, sum(fresh) / sum(flow) AS share FROM z WHERE k > 0 GROUP BY kind, host
), t AS (
  SELECT host, blocked - allowed + coalesce(d.share, 0) - coalesce(g.share, 0) AS score
  FROM o LEFT JOIN (FROM c WHERE kind = 'distrust') d USING (host) LEFT JOIN (FROM c WHERE kind = 'trust') g USING (host)
)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN round(coalesce(t.score, 0), {PLACES}) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t ON t.host = r.host
"""


SQL = _sql()
