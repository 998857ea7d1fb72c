"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (1: bad) are summed by host; a host's bad rate has a Beta prior whose mean is its registered
domain's posterior mean, which in turn is shrunk to its public suffix, and that to the whole. The strength of each
prior (its number of pseudo pages) is estimated from the spread of the children's rates by the method of moments. A host
is blocked if the lower bound of its posterior exceeds `max_bad`.

Only DataFrame functions. Counts are summed by host in the map stage, so a host with a third of all pages is one row
per task in the shuffle; everything after works on one row per host, from a stored table of them, so pages are read once for
counts and once for verdicts.

Defined results: null url, or one without `://`: host and path are empty, no rule fits, and the empty host has a
reputation like any other. Null outcome: the page is judged but counts nowhere. Rules of one length: the first in order that
fits counts. Very long urls and pages are read whole. Empty tables give empty results. Repeated rows are judged each, and
count each; page ids are not looked at. Other columns of `pages`, whatever their names, are kept unless named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.sources.tables import durable, table

#: Host suffix, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "com.cn")

def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `host/path`, and its verdict; nulls if none does."""
    name = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = rule_fits(host, path, rule_host, rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def suffix_of(host: Column) -> Column:
    plain = F.regexp_replace(host, r"(:\d*|\.)$", "")
    two = F.substring_index(plain, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(plain, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    plain = F.regexp_replace(host, r"(:\d*|\.)$", "")
    two = F.substring_index(plain, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(plain, ".", -3)).otherwise(two)


def page_outcome(html: Column) -> Column:
    """A weak label of a page, from its visible text alone: 1 if over a fiftieth of it is symbol noise. The host, whose
    reputation is made of it, has no part in it."""
    shown = F.regexp_replace(html, r"<[^<>]*>", " ")
    noise = F.length(shown) - F.length(F.translate(shown, "*$%&#!|", ""))
    return F.coalesce(noise > F.length(shown) / 50, F.lit(False)).cast("int")


def _strength(children: DataFrame, key: str, mean: str) -> DataFrame:
    """Pseudo pages of the prior of a parent's children: mean(1-mean)/variance - 1, where the variance is the
    page-weighted spread of the children's rates beyond what chance makes; between 2 and 1000."""
    rate = F.col("bad") / F.col("pages")
    spread = F.sum(F.col("pages") * (rate - F.col(mean)) ** 2) / F.sum("pages")
    chance = F.first(mean) * (1 - F.first(mean)) * F.count("*") / F.sum("pages")
    most = F.first(mean) * (1 - F.first(mean))
    found = children.where("pages > 0").groupBy(key).agg(spread.alias("spread"), chance.alias("chance"), most.alias("most"))
    beyond = F.greatest(F.col("spread") - F.col("chance"), F.lit(1e-6))
    return found.select(key, F.least(F.greatest(F.col("most") / beyond - 1, F.lit(2.0)), F.lit(1000.0)).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """outcomes: host, bad (0, 1 or null). One row per host: pages, bad, posterior mean, lower and upper bound."""
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("pages"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    hosts = durable(hosts)
    sums = [F.sum("pages").alias("pages"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(1))
    whole = suffixes.groupBy("all").agg(*sums).select("all", ((F.col("bad") + 1) / (F.col("pages") + 2)).alias("mean_all"))

    suffixes = suffixes.join(whole, "all")
    suffixes = suffixes.join(_strength(suffixes, "all", "mean_all"), "all", "left").select(
        "suffix", _posterior("mean_all").alias("mean_suffix"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.join(_strength(domains, "suffix", "mean_suffix"), "suffix", "left").select(
        "domain", "suffix", _posterior("mean_suffix").alias("mean_domain"))
    # stored sides, so that a domain with very many hosts can be split
    hosts = durable(hosts.join(durable(domains), ["domain", "suffix"]))
    hosts = hosts.join(durable(_strength(hosts, "domain", "mean_domain")), "domain", "left")
    strength = F.coalesce(F.col("strength"), F.lit(2.0))
    a, n = F.col("bad") + strength * F.col("mean_domain"), F.col("pages") + strength
    mean = a / n
    sd = F.sqrt(mean * (1 - mean) / (n + 1))
    return hosts.select(
        "host", "pages", "bad", mean.alias("bad_rate"),
        F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"), F.least(mean + z * sd, F.lit(1.0)).alias("upper"))


def _posterior(mean: str) -> Column:
    strength = F.coalesce(F.col("strength"), F.lit(2.0))
    return (F.col("bad") + strength * F.col(mean)) / (F.col("pages") + strength)


def filter_urls(pages: DataFrame, outcome: Column, rules=RULES, max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """Every page with host, path, rule, bad_rate, lower, upper and verdict (allow or block)."""
    results = ("host", "path", "rule", "bad_rate", "lower", "upper", "verdict")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = durable(reputation(pages.select(host.alias("host"), outcome.alias("bad")), z).select("host", "bad_rate", "lower", "upper"))
    kept = F.struct(*[c for c in pages.columns if c.lower() not in results])
    rule, by_rule = apply_rules(F.col("host"), F.col("path"), rules)
    judged = pages.select(kept.alias("row"), host.alias("host"), path.alias("path")).join(known, "host", "left")
    method = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    return judged.select("row.*", "host", "path", rule.alias("rule"), "bad_rate", "lower", "upper", F.coalesce(by_rule, method).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = filter_urls(pages, page_outcome(F.col("html")))
    rates = [F.round(c, 6).alias(c) for c in ("bad_rate", "lower", "upper")]
    return judged.select("page_id", "host", "path", "rule", "verdict", *rates)
