"""URL filtering by rules and by empirical-Bayes host reputation, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, staged, unpacked

#: Public suffixes of more than one label that the registered domain must not be cut inside of: a short list of common
#: ones, to be replaced by a current full list through ``suffixes``.
LONG_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], what: str) -> Column:
    """The longest of ``(verdict, host, path)`` rules that fits, as its text or its verdict; null if none fits."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(verdict if what == "verdict" else rule_host + rule_path)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def suffix_of(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """Suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(units: DataFrame, n: str, good: str) -> Column:
    """Struct of the sums that ``_kappa`` needs, over units with counts ``n, good``."""
    x, g = F.col(n).cast("double"), F.col(good).cast("double")
    return F.struct(
        F.count("*").cast("double").alias("k"), F.sum(n).cast("double").alias("N"), F.sum(good).cast("double").alias("S"),
        F.sum(x * x).alias("N2"), F.sum(g * g / x).alias("Q"),
    )


def _kappa(sums) -> float:
    """Prior strength of a beta-binomial by the method of moments; 9 where the units cannot tell."""
    k, total, good, squares, q = (float(sums[c] or 0) for c in ("k", "N", "S", "N2", "Q"))
    if k < 2 or total <= k:
        return 9.0
    between, within = (q - good * good / total) / (k - 1), (good - q) / (total - k)
    n0 = (total - squares / total) / (k - 1)
    if between + (n0 - 1) * within <= 0:
        return 9.0
    rho = (between - within) / (between + (n0 - 1) * within)
    return 1 / min(max(rho, 0.001), 0.5) - 1


def host_reputation(counts: DataFrame, hosts: DataFrame, z: float = 1.645, min_good: float = 0.5, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """Posterior share of good pages for every row of ``hosts`` (distinct ``host``).

    ``counts`` has one row ``host, n, good`` for each host with labelled pages. A suffix's rate shrinks to the overall
    rate, a registered domain's to its suffix's, a host's to its domain's, each through a beta prior whose strength
    is estimated from the spread at its own level (three rows of sums reach the driver). ``lower`` is the posterior
    mean less ``z`` posterior deviations; ``verdict`` is allow where ``lower >= min_good``. Without any label the
    overall rate is one half. ``suffixes`` lists the public suffixes of two labels.
    """
    host = F.col("host")
    by_host = counts.where("n > 0").select("host", "n", "good", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("nd"), F.sum("good").alias("gd"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("nd").alias("ns"), F.sum("gd").alias("gs"))
    sums = [u.agg(_strength(u, n, g).alias("x")).first()["x"] for u, n, g in ((by_suffix, "ns", "gs"), (by_domain, "nd", "gd"), (by_host, "n", "good"))]
    ks, kd, kh = map(_kappa, sums)
    overall = (float(sums[0]["S"] or 0) + 0.5) / (float(sums[0]["N"] or 0) + 1.0)

    def shrunk(good: str, n: str, kappa: float, prior: Column) -> Column:
        return (F.coalesce(F.col(good), F.lit(0)) + kappa * prior) / (F.coalesce(F.col(n), F.lit(0)) + kappa)

    levels = hosts.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"))
    levels = levels.join(by_suffix, "suffix", "left").join(by_domain.drop("suffix"), "domain", "left")
    levels = levels.join(by_host.select("host", "n", "good"), "host", "left")
    levels = levels.withColumn("mean", shrunk("good", "n", kh, shrunk("gd", "nd", kd, shrunk("gs", "ns", ks, F.lit(overall)))))
    strength = F.coalesce(F.col("n"), F.lit(0)) + kh
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strength + 1))
    return levels.select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), "mean", lower.alias("lower")).withColumn(
        "verdict", F.when(F.col("lower") >= min_good, "allow").otherwise("block")
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **bounds) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every page (needs ``url``; other columns stay, clashing ones are replaced).

    A page is labelled if the last number in its path is a ``doc_id`` of ``labels``; its outcome is good if every
    label row of that id has quality 1 and toxic 0 (rows with a null in either say nothing). Rules come first,
    the longest that fits; other pages get their host's verdict by the lower posterior bound. A url that is null or
    has no ``://`` has an empty host, judged like any host. Hosts are joined by value: a hot host is split by
    adaptive execution, and its outcomes are summed before they are shuffled.
    """
    parsed = packed(pages, host=url_host(F.col("url")), path=url_path(F.col("url")))
    number = F.regexp_extract("path", "([0-9]{1,18})[^0-9]*$", 1)
    refs = parsed.select("host", F.when(number != "", number.cast("long")).alias("ref")).groupBy("host", "ref").agg(F.count("*").alias("pages"))
    outcome = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("ref"))
        .agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    )
    labelled = refs.where(F.col("ref").isNotNull()).join(outcome, "ref")
    weighted = labelled.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("good")).alias("good"))
    # Four small jobs read these counts; the pages are parsed for them once.
    verdicts = host_reputation(staged(weighted), parsed.select("host").distinct(), **bounds).select("host", F.col("verdict").alias("by_host"))
    # Written first, so that the pages' side of the join below is a plain shuffle, which adaptive execution can split.
    verdicts = staged(verdicts)
    host, path = F.col("host"), F.col("path")
    out = parsed.join(verdicts, "host", "left")
    verdict = F.coalesce(matched_rule(host, path, rules, "verdict"), F.col("by_host"))
    return unpacked(out, host=host, path=path, rule=matched_rule(host, path, rules, "rule"), verdict=verdict)
