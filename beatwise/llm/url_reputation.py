"""URL filters: fixed rules first, then the reputation of the host.

Reputation is empirical Bayes: the outcomes of labelled pages are counted per host; the share of good pages of a host
is shrunk towards its registered domain, that towards its suffix and that towards all pages, each with the weight that
a beta-binomial model of the level fits to the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; all others are the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
#: Fixed rules: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is allowed if the lower bound of its good share, this many standard deviations below the mean, reaches FLOOR.
DEVIATIONS, FLOOR = 1.645, 0.5
#: Added to the counts of all pages, so that no labels at all means an even share.
EVEN = 1.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    return (F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1)))


def _weight(units: DataFrame) -> float:
    """Prior weight k = (1 - rho) / rho from the spread of the unit shares around their prior means (good, n, prior)."""
    var = F.col("prior") * (1 - F.col("prior"))
    row = units.filter("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("seen"),
                                    F.sum(var).alias("chance"), F.sum(var * (F.col("n") - 1)).alias("room")).first()
    if not row["room"]:
        return 100.0
    rho = min(0.5, max(0.001, ((row["seen"] or 0.0) - row["chance"]) / row["room"]))
    return round((1 - rho) / rho, 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Host, n, good, mean, bound: the posterior of every host of ``pages`` (host, and page key ``key``).

    ``outcomes`` has ``key`` and ``good`` (1 or 0, null: no outcome), at most one row a key counts. Counts are summed
    before they meet, so a host with any share of the rows is one row per task. Hosts without labelled pages get their
    domain's share.
    """
    labelled = outcomes.filter("good is not null and key is not null").groupBy("key").agg(F.min("good").alias("good"))
    seen = pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("rows")).join(labelled, "key", "left")
    hosts = seen.groupBy("host").agg(F.sum(F.when(F.col("good").isNotNull(), F.col("rows")).otherwise(0)).alias("n"),
                                     F.sum(F.coalesce(F.col("good") * F.col("rows"), F.lit(0))).alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = ((total["good"] or 0) + EVEN) / ((total["n"] or 0) + 2 * EVEN)

    def shrunk(units: DataFrame) -> tuple[DataFrame, float]:
        weight = _weight(units)
        return units.withColumn("mean", (F.col("good") + F.col("prior") * weight) / (F.col("n") + weight)), weight

    suffixes, _ = shrunk(suffixes.withColumn("prior", F.lit(share)))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts, weight = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + weight + 1))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """Page_id, host, path, rule, verdict, bound of every row of ``pages`` (page_id, url).

    ``outcomes`` is as in ``host_reputation``, keyed by the document number that follows the first part of the path.
    A url that is null or has no ``://`` has empty host and path and is judged as the host of that name. Repeated
    rows are judged each; an empty table gives an empty table.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.regexp_extract("path", r"^/[^/]*/([0-9]{1,18})(?:[^0-9].*)?$", 1)
    keyed = parts.select("host", F.when(key != "", key.cast("long")).alias("key"))
    known = host_reputation(keyed, outcomes).select("host", "mean", "bound")
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("bound") >= floor, "allow").otherwise("block")).alias("verdict"),
        F.round("mean", 6).alias("good_share"), F.round("bound", 6).alias("bound"))
