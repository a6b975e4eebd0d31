"""Empirical-Bayes host reputation: verdicts on urls from rules and from shrunk outcome rates of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import ascii_lower
from foldline.session import cut_lineage

#: Suffixes of two labels under which names are registered; a parameter, the public list can be passed in.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    after = F.substr(_rest(url), F.length(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)) + 1)
    return F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def with_levels(hosts: DataFrame, double_suffixes: Sequence[str]) -> DataFrame:
    """Suffix and registered domain of each ``host`` (a port is no part of them)."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    suffix_labels = F.when((n >= 2) & two.isin(*double_suffixes), 2).otherwise(1)

    def last(k):
        return F.concat_ws(".", F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k))

    return hosts.withColumns({"suffix": last(suffix_labels), "domain": last(suffix_labels + 1)})


def _strength(groups: DataFrame) -> DataFrame:
    """Method of moments for the beta prior: over-dispersion of ``bad / n`` around ``prior``, as a count of pseudo-outcomes."""
    v = F.col("prior") * (1 - F.col("prior"))
    s = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    rho = F.try_divide(F.sum(s) - F.sum(v), F.sum(v * (F.col("n") - 1)))
    return groups.filter("n > 0").agg(F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.001)), F.lit(0.5)).alias("rho")).select((1 / F.col("rho") - 1).alias("strength"))


def _shrink(groups: DataFrame) -> DataFrame:
    """Posterior mean and total of pseudo-outcomes of each group under a beta prior around ``prior``."""
    return groups.withColumn("strength", _strength(groups).scalar()).withColumns({
        "mass": F.col("strength") + F.col("n"),
        "mean": (F.col("prior") * F.col("strength") + F.col("bad")) / (F.col("strength") + F.col("n")),
    }).drop("strength")


def reputations(pages: DataFrame, outcomes: DataFrame, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> DataFrame:
    """One row per distinct host of ``pages`` (page_id, url): ``mean`` and ``sd`` of the posterior rate of bad outcomes.

    ``outcomes`` (page_id, bad 0/1) may cover few pages. Counts go up from host to registered domain to suffix; beta-binomial
    priors go down again: a suffix is shrunk to the overall rate, a domain to its suffix, a host to its domain. The
    strength of each prior is estimated from the spread of the groups of its level. A host without outcomes has its
    domain's rate, and without any outcome at all every rate is one half. Null ids meet no outcome; of several outcomes of
    one page each counts.
    """
    seen = pages.select(F.col("page_id").alias("__id"), host_of(F.col("url")).alias("host"))
    bad = outcomes.filter("bad IS NOT NULL").groupBy(F.col("page_id").alias("__id")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = seen.join(bad, "__id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut_lineage(with_levels(hosts, double_suffixes))

    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = _shrink(hosts.groupBy("suffix").agg(*sums).withColumn("prior", total.scalar())).select("suffix", F.col("mean").alias("prior"))
    domain = _shrink(hosts.groupBy("suffix", "domain").agg(*sums).join(suffix, "suffix")).select("domain", F.col("mean").alias("prior"))
    host = _shrink(hosts.join(domain, "domain"))
    return host.select(
        "host", "domain", "suffix", "n", "bad", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("mass") + 1)).alias("sd")
    )


def matched_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules (host, path, verdict) of itself and of the domains above it, as one array."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("__at"))
    r = rules.select(F.col("host").alias("__at"), F.struct(F.concat("host", "path").alias("rule"), F.col("path").alias("start"), F.col("verdict").alias("says")).alias("r"))
    return above.join(r, "__at").groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("rules"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: DataFrame, bound: float = 0.5, z: float = 1.645, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES
) -> DataFrame:
    """page_id, host, path, rule, verdict and the reputation of every row of ``pages``.

    The longest rule that fits decides: same host or a subdomain, and the path starts with the rule's path (of equal
    rules allow wins). Else a host is blocked if its rate of bad outcomes is above ``bound`` with the confidence of
    ``z`` standard deviations of the posterior. Null urls have empty host and path and are judged like any host; repeated
    rows are kept; other columns are ignored. The joins are on host: its side with one row per host is written first,
    so that a hot host's pages can be split.
    """
    rep = reputations(pages, outcomes, double_suffixes)
    known = cut_lineage(rep.join(matched_rules(rep.select("host"), rules), "host", "left"))
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), (r["says"] == "allow").alias("first"), r["says"].alias("says"))))
    sure_bad = F.col("mean") - z * F.col("sd") > bound
    return p.join(known, "host", "left").withColumn("__r", longest).select(
        "page_id", "host", "path", F.col("__r.rule").alias("rule"),
        F.coalesce(F.col("__r.says"), F.when(sure_bad, "block").otherwise("allow")).alias("verdict"),
        "domain", "n", F.round("mean", 6).alias("bad_rate"), F.round(F.col("mean") - z * F.col("sd"), 6).alias("bad_rate_low"),
    )
