"""URL filtering by rules and by trust and distrust spread over host links (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import UPPER, Scratch, salted_join

#: Fixed values: (action, host, path).
DEFAULT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Steps of the ranks from one written table to the next.
STEPS = 8
#: Links (rows of a host, a host and two numbers) up to which the ranks are computed in one task, without shuffles; beyond, links of a host are dealt over SALTS tasks.
ONE_TASK, SALTS = 400_000, 64

HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, UPPER.lower())).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and action of the longest rule whose host is `host` or a parent domain and whose path begins `path`."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted links (src, dst, n) between hosts: absolute links in the html, and each host's links with its parent domain."""
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))
    linked = pages.select(F.col("host").alias("src"), F.explode(F.transform(targets, lambda x: F.translate(x, UPPER, UPPER.lower()))).alias("dst"))
    linked = linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    up = pages.select("host").distinct().withColumn("labels", F.split("host", r"\."))
    # a domain of two labels is the highest parent, since what lies above belongs to a registry
    up = up.where("size(labels) > 2").select("host", F.explode(F.expr("transform(sequence(0, size(labels) - 3), i -> struct(array_join(slice(labels, i + 1, size(labels)), '.') as low, array_join(slice(labels, i + 2, size(labels)), '.') as high))")).alias("e"))
    up = up.select("e.low", "e.high").distinct()
    tree = up.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(1.0).alias("n")).union(up.select("high", "low", F.lit(1.0)))
    return linked.union(tree).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-9, damping: float = 0.85, limit: int = 2000, one_task: int = ONE_TASK) -> DataFrame:
    """(host, trust, distrust): two personalised PageRanks at once.

    seeds has (host, trust, distrust), the restart mass of each. Trust follows the links from trusted
    seeds; distrust follows them backwards from blocked ones: who links to a bad host is suspect. A host
    without a link keeps its restart mass. Each step is a join and a sum by host, in one task for up to `one_task` links and over a hub host's
    salted links beyond; the ranks are written to the shared folder after every
    STEPS of them. They end when all hosts' ranks together grow by less than `tolerance` in these and neither rank
    reaches a further host; more than `limit` steps are an error.
    """
    scratch = Scratch(edges.sparkSession)
    out_n = edges.groupBy("src").agg(F.sum("n").alias("all"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = salted_join(edges, out_n, ["src"]).select(F.col("src").alias("host"), F.col("dst").alias("target"), (F.col("n") / F.col("all")).alias("f"), F.lit(0.0).alias("b"))
    back = salted_join(edges, in_n, ["dst"]).select(F.col("dst").alias("host"), F.col("src").alias("target"), F.lit(0.0).alias("f"), (F.col("n") / F.col("all")).alias("b"))
    links = forward.union(back).groupBy("host", "target").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    links = scratch.table(links.withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)).cast("int")))
    small = links.count() <= one_task
    met = (lambda df: df.coalesce(1)) if small else (lambda df: df)  # one partition meets another without a shuffle
    pairs = None if small else scratch.table(links.select("host", "salt").distinct())
    nodes = links.select("host").union(seeds.select("host")).distinct()
    keep = 1 - damping
    start = nodes.join(seeds, "host", "left").select("host", (keep * F.coalesce("trust", F.lit(0.0))).alias("trust"), (keep * F.coalesce("distrust", F.lit(0.0))).alias("distrust"))
    start = scratch.table(start)
    ranks, old, before, sums = start, None, None, (0.0, 0.0)
    for _ in range(0, limit, STEPS):
        for _ in range(STEPS):
            joined = met(links).join(met(ranks).hint("merge"), "host") if small else links.join(pairs.join(ranks, "host"), ["host", "salt"])
            sent = joined.select(F.col("target").alias("host"), (damping * F.col("trust") * F.col("f")).alias("trust"), (damping * F.col("distrust") * F.col("b")).alias("distrust"))
            ranks = met(start.union(sent)).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        ranks = scratch.table(ranks)
        if old is not None:
            scratch.drop(old)
        old, last = ranks, sums
        *reached, t, d = ranks.agg(F.count_if(F.col("trust") > 0), F.count_if(F.col("distrust") > 0), F.sum("trust"), F.sum("distrust")).first()
        # from the restart masses alone no host's rank ever falls, so the sums' growth is the total change
        sums = (t or 0.0, d or 0.0)
        grown = sum(sums) - sum(last)
        if grown < tolerance and reached == before:
            return ranks
        before = reached
    raise RuntimeError(f"host ranks still grow by {grown} after {limit} steps")


def url_filter(pages: DataFrame, rules=DEFAULT_RULES, threshold: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, trust, distrust.

    A fitting rule decides (the longest one); every other page gets the verdict of its host: block if the
    distrust that reaches the host is above `threshold` times its trust, else allow. A host's seed masses
    are the shares of all allowed and of all blocked pages that it has, so both sum to one.

    Cases: a null url, or one without `://`, has empty host and path, fits no rule with a path and is
    allowed; null html has no links; a very long page is read whole; of rules of equal length the one that sorts last wins; distrust equal
    to `threshold` times the trust (so none of either) allows; repeated rows each get their row; an empty table gives no rows;
    other columns are ignored.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    pages = pages.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    name, action = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "host", "path", name.alias("rule"), action.alias("action"))
    scratch = Scratch(pages.sparkSession)
    edges = scratch.table(host_edges(pages.select("host", "html")))
    masses = judged.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
    masses = scratch.table(masses)
    all_a, all_b = masses.agg(F.sum("a"), F.sum("b")).first()
    seeds = masses.select("host", (F.col("a") / F.lit(float(all_a or 1))).alias("trust"), (F.col("b") / F.lit(float(all_b or 1))).alias("distrust"))
    ranks = propagate(edges, seeds)
    out = salted_join(judged, ranks, ["host"])
    spread = F.when(F.col("distrust") > threshold * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("host") == "", F.coalesce("action", F.lit("allow"))).otherwise(F.coalesce("action", spread)).alias("verdict"), "trust", "distrust")
