"""URL filter by empirical-Bayes host reputation, with explicit rules first.

DataFrame functions only. Pages whose outcome is known (``blocked`` true or false) are
counted by site (the host without user and port), registered domain and suffix. The suffix is
the last label, or the last two where a country's label follows one that many countries sell
names under; the registered domain has one label more. An address of numbers is a domain and
suffix of its own. At each level the rate of blocked pages is shrunk towards the level above through a
beta-binomial prior, whose strength is fitted by moments from how the rates of the level's
units spread. A host is blocked if the lower bound of its posterior rate lies above the
threshold.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule
and is judged on the overall prior of the empty suffix. With no known outcome all priors
are even and nothing is blocked. Repeated rows are judged alike; each counts. Of rules of one
length the last in order of their texts wins. An empty table gives an empty one; urls of any
length are read whole. Columns to keep may have any names but those of the new ones, ``_ruled`` and ``_site``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.llm.store import Scratch


@dataclass(frozen=True)
class Parameters:
    """z: posterior standard deviations below the mean at the bound. Prior strengths lie between the two limits, in pages."""

    z: float = 1.645
    threshold: float = 0.5
    least_strength: float = 1.0
    most_strength: float = 1000.0


#: allow or block, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


#: Labels below which registries of many countries sell names.
REGISTRY_LABELS = "ac|co|com|edu|gob|gouv|gov|go|gv|mil|ne|net|nom|or|org|sch"


def site(host: Column) -> Column:
    """A host without user, port and closing dots."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+(:[0-9]*)?$", "")


def domain_and_suffix(site: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a site."""
    number = F.rlike(site, F.lit(r"^[0-9]+(\.[0-9]+){3}$|^\["))
    two = F.rlike(site, F.lit(rf"(^|\.)({REGISTRY_LABELS})\.[a-z][a-z]$"))
    last = lambda n: F.substring_index(site, ".", -n)
    return F.when(number, site).when(two, last(3)).otherwise(last(2)), F.when(number, site).when(two, last(2)).otherwise(last(1))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "?", 1), "#", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together) and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda x: (len(x[1]) + len(x[2]), x)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _strength(units: DataFrame, p: Parameters) -> float:
    """Pages that the prior of one level weighs, from the spread of ``b / n`` over its units (one row of sums on the driver)."""
    units = units.where("n > 0")
    j, n, b, squares = units.agg(F.count("*"), F.sum("n"), F.sum("b"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    if j < 2 or not 0 < b < n:
        return p.most_strength
    m = b / n
    spread = units.agg(F.sum(F.col("n") * (F.col("b") / F.col("n") - F.lit(m)) ** 2)).first()[0]
    between = (spread - (j - 1) * m * (1 - m)) / (n - squares / n) if n > squares / n else 0.0
    return min(p.most_strength, max(p.least_strength, m * (1 - m) / between - 1)) if between > 0 else p.most_strength


def reputations(outcomes: DataFrame, scratch: Scratch, p: Parameters = Parameters()) -> DataFrame:
    """``host`` and ``bound``, the lower posterior bound of its rate, for each host of ``outcomes`` (host, blocked; null: unknown)."""
    hosts = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("b"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = scratch.write(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = scratch.write(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "domains")
    suffixes = scratch.write(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "suffixes")
    n, b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    shrunk = lambda prior, k: (F.col("b") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(F.lit((b + 1) / (n + 2)), _strength(suffixes, p)).alias("above"))
    domains = scratch.write(domains.join(suffixes, "suffix").select("domain", shrunk(F.col("above"), _strength(domains, p)).alias("prior")), "priors")
    k = _strength(hosts, p)
    mean = shrunk(F.col("prior"), k)
    bound = mean - F.lit(p.z) * F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(k) + 1))
    return scratch.write(hosts.join(domains, "domain").select("host", F.round(bound, 9).alias("bound")), "reputations")


def judge(pages: DataFrame, keep: list[str], rules=RULES, p: Parameters = Parameters()) -> DataFrame:
    """The columns ``keep`` of ``pages`` and ``host``, ``path``, ``rule``, ``verdict``, ``bound``. The outcomes known are the rules' verdicts."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select(*keep, host.alias("host"), path.alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumns({"rule": name, "_ruled": verdict, "_site": site(F.col("host"))})
    found = reputations(ruled.select(F.col("_site").alias("host"), (F.col("_ruled") == "block").alias("blocked")), Scratch(pages.sparkSession, "urls"), p)
    found = found.withColumnRenamed("host", "_site")
    judged = F.when(F.col("bound") > p.threshold, "block").otherwise("allow")
    return ruled.join(found, "_site").select(*keep, "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), "bound")
