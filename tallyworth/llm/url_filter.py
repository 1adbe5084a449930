"""Judge pages by rules on their address, and hosts by a shrunken record of labelled pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


# The rules.
RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
# Suffixes of more than one label under which owners register names.
SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp",
    "ac.jp", "com.br", "org.br", "com.ar", "com.mx", "com.co", "com.pe", "com.tr", "com.cn", "net.cn", "org.cn", "com.tw", "com.hk",
    "com.sg", "com.my", "co.in", "co.id", "co.kr", "co.th", "co.il", "co.za", "com.ua", "com.pl", "com.pt", "com.es",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app", "web.app", "pages.dev",
)
# What is left out of a host for its domain (user, port, last dot), and addresses made of numbers.
LEFT_OUT = r"^.*@|:[0-9]*$|\.$|\.?:[0-9]*$"
NUMERIC = r"^[0-9]+(\.[0-9]+)*$|^\["
# Bound: standard deviations below the posterior mean; a host is blocked if its bad share surely exceeds LIMIT.
DEVIATIONS = 1.645
LIMIT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or an address without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path starts the path; else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(rule.rule)).otherwise(chosen)
    return chosen


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (one label more than the suffix) and suffix of a host without its user, port and last dot.

    The suffix is the longest of `suffixes` that ends the host, else the last label. An address of numbers is a domain of
    its own, under the empty suffix; a host that is a suffix is its own domain.
    """
    bare = F.regexp_replace(host, LEFT_OUT, "")
    domain, suffix = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(bare, ".", -labels)
        listed = end.isin(*(s for s in suffixes if s.count(".") + 1 == labels))
        domain = F.when(listed, F.substring_index(bare, ".", -labels - 1)).otherwise(domain)
        suffix = F.when(listed, end).otherwise(suffix)
    numeric = bare.rlike(NUMERIC)
    return F.when(numeric, bare).otherwise(domain), F.when(numeric, "").otherwise(suffix)


def _strength(units: DataFrame) -> float:
    """Prior strength a + b of a beta-binomial over units (n, bad), by moments; one row comes back."""
    total = units.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("n").cast("double").alias("n"),
        F.sum("bad").cast("double").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    if not total["units"] or total["units"] < 2:
        return MOST_STRENGTH
    mean = total["bad"] / total["n"]
    spread = mean * (1 - mean)
    free = total["n"] - total["nn"] / total["n"] - (total["units"] - 1)
    if spread == 0 or free <= 0:
        return MOST_STRENGTH
    between = total["bb"] - total["bad"] * mean - (total["units"] - 1) * spread
    rho = between / (spread * free)
    return MOST_STRENGTH if rho <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - rho) / rho))


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Every host of `outcomes` (host, bad 0/1 or null for an unlabelled page) with bad_rate and bound.

    The record of a host is shrunk to that of its registered domain, which is shrunk to that of its suffix, and that
    to all pages. The strength of each prior comes from the spread among the units of its level.
    Without any label every rate is 0.5 and no bound exceeds it.
    """
    counts = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = written(outcomes.groupBy("host").agg(*counts).withColumns({"domain": domain, "suffix": suffix}), "hosts")

    def summed(by: str, *more: str) -> DataFrame:
        return hosts.groupBy(by, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    domains, ends = summed("domain", "suffix"), summed("suffix")
    labelled = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((labelled["bad"] or 0) + 1.0) / ((labelled["n"] or 0) + 2.0)
    of_suffix, of_domain, of_host = (_strength(x.filter("n > 0")) for x in (ends, domains, hosts))

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("bad") + prior * strength) / (F.col("n") + strength)

    by_suffix = ends.select("suffix", shrunk(F.lit(overall), of_suffix).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", "suffix", shrunk(F.col("suffix_rate"), of_domain).alias("domain_rate")
    )
    rate = F.col("bad_rate")
    return (
        hosts.join(by_domain, ["domain", "suffix"])
        .withColumn("bad_rate", shrunk(F.col("domain_rate"), of_host))
        .select(
            "host",
            rate,
            (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("n") + of_host + 1))).alias("bound"),
        )
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every row of `pages` (page_id, url).

    `outcomes` (page_id, bad 0/1) labels some pages; an id labelled twice counts as bad if any label is. A page
    without a fitting rule is blocked if the posterior bound of its host's bad share is above LIMIT.
    Null or malformed addresses have an empty host, which has a record of its own. Repeated rows are each judged; no pages
    give no rows, and without outcomes no host is blocked by its record. `suffixes` are those of more than one label.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    # A host may hold a third of all pages: its counts are summed before they are shuffled, and the join back is one
    # that Spark splits where it is skewed.
    reputation = host_reputation(split.select("page_id", "host").join(known, "page_id", "left"), suffixes)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.rule, F.lit(r.verdict)).otherwise(by_rule)
    by_host = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return (
        split.join(reputation, "host", "left")
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "bad_rate", "bound")
    )
