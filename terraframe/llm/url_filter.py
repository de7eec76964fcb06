"""URL filters: rules first, then trust and distrust propagated over host links.

Each URL gets the longest rule that fits it (a rule names a host, with all its
subdomains, and a path prefix).  URLs without a rule are judged by their host:

* host edges are counted from the links of all pages (a relative link stays on
  its host), source and target host pre-aggregated before anything else;
* trust flows from hosts with allowed pages along links (personalised
  PageRank); distrust flows from hosts with blocked pages against them;
* a host is blocked if its distrust exceeds its trust and is at least
  ``threshold`` of the host's own share of all pages, else allowed.

Seeds are weighted by the share of ruled pages, so one blocked path doesn't
condemn a host.  A host without outgoing links keeps its mass.  Everything is
DataFrame functions; ranks and edges stay distributed, the lineage of the
iteration is cut by tables in the shared folder.

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no rule and counts as a host of its own; null html has no links; repeated rows
are judged alike and weigh as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop_table, join_split, read, write_table

EPSILON = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The first href of an <a> element, quoted or bare; SQL's expression engine takes linear time for it.
HREF = r"""(?is)<a(?:\s[^>]*?)??\shref\s*=\s*["']?([^"'\s>]+)"""

#: An <a> up to the end of its tag, and in it what decides about links: each is found in time linear in its length.
TAG = r"(?is)<a(?=\s)[^>]*+"
PARTS = r"""(?is)<a(?=\s)|\shref\s*+=\s*+["']?[^"'\s>]++"""


def hrefs(html: Column) -> Column:
    """The same links as HREF's: of each <a> the next href before the end of a tag, in time linear in the text.

    A backtracking engine would look for it from every <a> to the end of the page.
    """

    def of_tag(tag: Column) -> Column:
        parts = F.regexp_extract_all(tag, F.lit(PARTS), F.lit(0))
        pairs = F.zip_with(parts, F.concat(F.array(F.lit("")), parts), lambda x, p: F.struct(x.alias("x"), p.alias("p")))
        found = F.filter(pairs, lambda t: F.lower(t["p"]).eqNullSafe("<a") & F.lower(t["x"]).contains("href"))
        return F.transform(found, lambda t: F.regexp_extract(t["x"], r"""(?is)^\shref\s*+=\s*+["']?([^"'\s>]++)""", 1))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(0)), of_tag))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


RULES = [rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, null without one.  ``rules`` is a short literal list."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if text is None else (text, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) over all links of all pages; needs columns host and html."""
    links = F.filter(hrefs(F.col("html")), lambda x: ~F.lower(x).rlike(r"^(mailto|javascript|tel|data):"))
    per_page = pages.select("host", links.alias("links"))
    away = F.filter(F.col("links"), lambda x: x.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    per_page = per_page.select("host", away.alias("away"), (F.size("links") - F.size(away)).alias("home"))
    other = per_page.select("host", F.explode("away").alias("u")).select(F.col("host").alias("src"), host_of(F.when(F.col("u").startswith("//"), F.concat(F.lit("x:"), F.col("u"))).otherwise(F.col("u"))).alias("dst"), F.lit(1).alias("n"))
    own = per_page.filter("home > 0").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.col("home").alias("n"))
    return other.union(own).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int = 12, damping: float = 0.85, every: int = 4) -> DataFrame:
    """Ranks after so many steps of r = (1-damping) p + damping W r, per kind.

    ``seeds``: (kind, host, p); ``edges``: (kind, a, b, w) with the weights out
    of each a summing to one, a loop for hosts that keep their mass.  The edges of
    a hub are split, what flows into one host is pre-aggregated.
    """
    base = seeds.select("kind", "host", F.col("p").alias("r"))
    rank, last = base, None
    for i in range(iterations):
        flow = join_split(edges, rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("r") * F.col("w") * damping).alias("r"))
        rank = flow.unionByName(base.select("kind", "host", (F.col("r") * (1 - damping)).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            rank, before = write_table(rank, "op7-rank"), last
            last = rank
            if before is not None:
                drop_table(before)
    return rank


def host_scores(judged: DataFrame, edges: DataFrame, iterations: int = 12, damping: float = 0.85, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(host, base, trust, distrust): shares of all pages.  ``judged``: one row a page with host and by_rule."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad"))
    hosts = write_table(hosts, "op7-hosts", scratch)
    total = float(hosts.agg(F.sum("pages")).first()[0] or 1)
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", (F.col("good") / total).alias("p")).union(hosts.select(F.lit("distrust"), "host", F.col("bad") / total)).filter("p > 0")
    edges = write_table(edges, "op7-edges", scratch)
    out_n, in_n = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = join_split(edges, out_n, ["src"]).select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    backward = join_split(edges, in_n, ["dst"]).select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    linked = forward.union(backward)
    # hosts that mass can reach and that no edge leaves
    nodes = seeds.select("kind", F.col("host").alias("a")).union(linked.select("kind", "b")).distinct()
    kept = nodes.join(linked.select("kind", "a").distinct(), ["kind", "a"], "left_anti")
    weights = write_table(linked.union(kept.select("kind", "a", F.col("a").alias("b"), F.lit(1.0).alias("w"))), "op7-weights", scratch)
    rank = propagate(seeds, weights, iterations, damping)
    by_host = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("r"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("r"))).alias("distrust"))
    return hosts.join(by_host, "host", "left").select("host", (F.col("pages") / total).alias("base"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", html: str = "html", carry: tuple[str, ...] = ("page_id",), iterations: int = 12, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """One row a page: ``carry``, host, path, rule, verdict, trust, distrust."""
    u = F.col(url)
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(*[F.col(c) for c in carry], host_of(u).alias("host"), path_of(u).alias("path"))
    judged = write_table(parsed.withColumns({"rule": text, "by_rule": verdict}), "op7-judged")
    edges = host_edges(pages.select(host_of(u).alias("host"), F.col(html).alias("html")))
    scratch: list[DataFrame] = []
    scores = write_table(host_scores(judged, edges, iterations, damping, scratch), "op7-scores")
    drop_table(*scratch)
    # the order of a sum decides no verdict
    blocked = (F.col("distrust") > F.col("trust") * (1 + EPSILON)) & (F.col("distrust") >= threshold * F.col("base") * (1 - EPSILON))
    return judged.join(scores, "host", "left").select(*carry, "host", "path", "rule", F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def sql(rules: list[Rule] = RULES, iterations: int = 12, damping: float = 0.85, threshold: float = 0.5) -> str:
    """The query in DuckDB's SQL, the iterations written out."""
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    order = sorted(rules, key=lambda r: -len(r.text))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in order]
    rule_sql = " ".join(f"{f} THEN '{r.text}'" for f, r in zip(fits, order))
    verdict_sql = " ".join(f"{f} THEN '{r.verdict}'" for f, r in zip(fits, order))
    href = HREF.replace("'", "''")
    steps = ["r0 AS (SELECT kind, host, p AS r FROM seeds)"]
    for k in range(iterations):
        flow = f"SELECT r.kind, coalesce(w.b, r.host) AS host, r.r * coalesce(w.w, 1.0) * {damping} AS r FROM r{k} r LEFT JOIN w ON r.kind = w.kind AND r.host = w.a"
        steps.append(f"r{k + 1} AS (SELECT kind, host, sum(r) AS r FROM ({flow} UNION ALL SELECT kind, host, p * (1 - {damping}) FROM seeds) GROUP BY kind, host)")
    return f"""
WITH p AS (SELECT page_id, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, CASE {rule_sql} END AS rule, CASE {verdict_sql} END AS by_rule FROM p),
links AS (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS u FROM p),
targets AS (SELECT host AS src, CASE WHEN regexp_matches(u, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN {host("CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END")} ELSE host END AS dst FROM links WHERE NOT regexp_matches(lower(u), '^(mailto|javascript|tel|data):')),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM targets GROUP BY src, dst),
h AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad, sum(count(*)) OVER () AS total FROM j GROUP BY host),
seeds AS MATERIALIZED (SELECT * FROM (SELECT 'trust' AS kind, host, good / total::DOUBLE AS p FROM h UNION ALL SELECT 'distrust', host, bad / total::DOUBLE FROM h) WHERE p > 0),
w AS MATERIALIZED (SELECT 'trust' AS kind, src AS a, dst AS b, n / (sum(n) OVER (PARTITION BY src))::DOUBLE AS w FROM e UNION ALL SELECT 'distrust', dst, src, n / (sum(n) OVER (PARTITION BY dst))::DOUBLE FROM e),
{", ".join(steps)},
s AS (SELECT host, sum(r) FILTER (kind = 'trust') AS trust, sum(r) FILTER (kind = 'distrust') AS distrust FROM r{iterations} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.by_rule, CASE WHEN coalesce(s.distrust, 0) > coalesce(s.trust, 0) * (1 + {EPSILON}) AND coalesce(s.distrust, 0) >= {threshold} * h.pages / h.total * (1 - {EPSILON}) THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN h ON j.host = h.host LEFT JOIN s ON j.host = s.host
""".strip()
