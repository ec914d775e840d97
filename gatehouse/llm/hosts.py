"""URL filters: listed rules first, then an empirical-Bayes reputation of hosts.

A rule fits its host, the subdomains of it, and paths that begin with its path; of several the longest wins. What no rule decides is decided
by how labelled pages of the host turned out. The share of bad pages is beta-binomial at four levels: all pages, suffix, registered domain,
host. Each level's prior has its parent's posterior mean; how strongly it shrinks comes from the data, by moments: were rates alike below
a parent, the squared distances of the counts from their expectation would be binomial variances, and what they exceed these by gives the
correlation within a node, rho, and the strength 1 / rho - 1. A host is blocked if the lower bound of its posterior, `z` deviations below the
mean, exceeds `limit`: a few bad pages of an unknown host don't, some of a host in a bad domain do.

All of it is expressions, joins and sums. Pages are counted by host with partial sums, and everything up to the verdicts is a table of hosts;
a host of more than one page in 10,000 is broadcast back, at most 10,000 are, and the others are joined by a shuffle. Rules are joined to hosts
by the hosts' own suffixes in the same manner, so a list of any size works.

The host lies after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path after it up to `?`, `#` or the end. Null urls
and those without `://` have neither, and are a host of their own, without a name. Ports and user names stay part of the host. Equal rules of both kinds
block. Outcomes of one id count once, as bad if any is; labels and pages without id stay unlinked, and each row of a repeated page counts. Without outcomes the
mean is a half and nothing is blocked. Other columns of any name are dropped; urls of any length pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: (host, path, verdict): the rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A host is blocked if its share of bad pages is above LIMIT by Z deviations of the posterior (95 % of a normal one).
LIMIT, Z = 0.5, 1.645
#: Bounds of the correlation within a node, so of the strengths of priors: 1 to 999 pages.
RHO = (0.001, 0.5)
#: Suffixes of two labels under which domains are registered; all other suffixes are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za")

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(url)))
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return pages.select("*", F.translate(part(r"^([^/?#]*)"), _UPPER, _SMALL).alias("host"), part(r"^[^/?#]*([^?#]*)").alias("path"))


def domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host, the label before its suffix and this, and the suffix."""
    suffix = F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)), suffix


def counted(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, domain, suffix, n_pages, n (pages with an outcome), bad: a row for each host. pages: page_id, host; outcomes: page_id, bad (0 or 1)."""
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    rows = pages.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("k"))
    marked = rows.where("page_id IS NOT NULL").join(known, "page_id").select("host", F.lit(0).cast("long").alias("n_pages"), F.col("k").alias("n"), (F.col("k") * F.col("bad")).alias("bad"))
    every = rows.select("host", F.col("k").alias("n_pages"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")).unionByName(marked)
    own, suffix = domain(F.col("host"), suffixes)
    return every.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n_pages", "n", "bad")]).select("host", own.alias("domain"), suffix.alias("suffix"), "n_pages", "n", "bad")


def _under(nodes: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """nodes joined to the level above, whose mean is their prior. above: key, mean; a node above with very many nodes is no hot task."""
    children = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("_children"))
    means = common.cut(above.select(key, F.col("mean").alias("prior")).join(children, key))
    return common.join_counted(nodes, means, key, "_children").drop("_children")


def _shrunk(nodes: DataFrame, rho: tuple[float, float]) -> DataFrame:
    """nodes (n, bad, prior) with the strength of their priors and mean, of their posteriors."""
    nodes = common.cut(nodes)
    m, n = F.col("prior"), F.col("n")
    spread = F.pow(F.col("bad") - n * m, 2) - n * m * (1 - m)
    room = n * (n - 1) * m * (1 - m)
    found = nodes.agg(F.sum(spread).alias("_spread"), F.sum(room).alias("_room"))
    low, high = rho
    share = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.col("_spread") / F.nullif(F.col("_room"), F.lit(0.0)), F.lit(low))))
    strength = found.select((1 / share - 1).alias("strength"))
    return nodes.crossJoin(F.broadcast(strength)).withColumn("mean", (F.col("bad") + F.col("strength") * m) / (n + F.col("strength")))  # one row


def reputation(hosts: DataFrame, limit: float = LIMIT, z: float = Z, rho: tuple[float, float] = RHO) -> DataFrame:
    """hosts, as of counted(), with bad_mean and bad_bound, the mean and the lower bound of the posterior, and blocked."""
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("prior"))
    counts = [F.sum(c).alias(c) for c in ("n", "bad")]
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*counts).crossJoin(F.broadcast(total)), rho)  # one row
    domains = _shrunk(_under(hosts.groupBy("domain", "suffix").agg(*counts), suffixes, "suffix"), rho)
    own = _shrunk(_under(hosts, domains, "domain"), rho)
    mean, size = F.col("mean"), F.col("n") + F.col("strength")
    bound = mean - z * F.sqrt(mean * (1 - mean) / (size + 1))
    return own.select("host", "n_pages", "n", "bad", mean.alias("bad_mean"), bound.alias("bad_bound"), (bound > limit).alias("blocked"))


def with_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts with `fitting`, the rules of each host or of what it is a subdomain of, as an array of length, path, verdict and rule. rules: host, path, verdict."""
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of allow and block, block
    name = F.concat("host", "path")
    listed = listed.groupBy(F.col("host").alias("above")).agg(F.collect_list(F.struct(F.length(name).alias("size"), F.length("host").alias("host_size"), name.alias("rule"), "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = hosts.select("host", F.explode(above).alias("above"))
    used = common.cut(listed.join(each.groupBy("above").agg(F.count(F.lit(1)).alias("n_hosts")), "above"))
    found = common.join_counted(each, used, "above", "n_hosts").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("fitting"))
    return hosts.join(found, "host", "left")


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, url: str = "url", limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES, rho: tuple[float, float] = RHO) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict (allow or block), n_outcomes, bad_mean and bad_bound of the host, for each page.

    pages: page_id and the url; outcomes: page_id, bad (0 or 1); rules: host, path, verdict.
    """
    rows = located(pages.select("page_id", url), url).select("page_id", "host", "path")
    hosts = common.cut(counted(rows, outcomes, suffixes))
    judged = common.cut(with_rules(reputation(hosts, limit, z, rho), rules))
    held = common.join_counted(rows, judged, "host", "n_pages")
    best = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["path"])))
    made = held.withColumn("best", best)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return made.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("n_outcomes"), "bad_mean", "bad_bound")


def op13_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the pages' ids: bad if of low quality or toxic."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad")
    outcomes = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    made = judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, rules)
    return made.withColumns({c: F.round(c, 6) for c in ("bad_mean", "bad_bound")})
