"""URL filter: explicit rules first, then the reputation of the host.

The share of bad pages of a host is shrunk towards that of its registered
domain, which is shrunk towards its suffix, which is shrunk towards all pages.
Each level is a beta-binomial prior whose strength comes from the spread of the
rates on that level. A host is blocked only if the lower posterior bound of its
share of bad pages lies above ``max_bad``.

Defined results: a null url or one without ``://`` has an empty host and path
and is judged as host ``""``; several outcomes of a page count each; a null
outcome is none; repeated pages are judged row by row; empty tables give an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Suffixes of two labels under which names are registered; others have one label.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au",
                 "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
MAX_BAD = 0.5
SIGMAS = 2.0


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    return df.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": F.translate(F.regexp_extract("__rest", "^[^/?#]*", 0), UPPER, UPPER.lower()),
        "path": F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1),
    }).drop("__rest")


def rule_column(rules: Sequence[tuple[str, str, str]], value: int | None = None) -> Column:
    """Longest fitting rule of ``(host, path, verdict)``: its text, or entry ``value`` of it."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        host, path, _ = rule
        fits = (F.concat(F.lit("."), F.col("host")).endswith("." + host)
                & F.startswith(F.col("path"), F.lit(path)))
        out = F.when(fits, F.lit(host + path if value is None else rule[value])).otherwise(out)
    return out


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``suffix``; addresses of numbers are their own domain without suffix."""
    name = F.regexp_replace(F.regexp_replace(F.col("host"), "^.*@", ""), ":[0-9]*$", "")
    parts = F.filter(F.split("__name", "\\.", -1), lambda x: x != "")
    tail = lambda n: F.array_join(
        F.slice("__parts", F.greatest(F.lit(1), F.size("__parts") - n + 1), n), ".")
    numeric = F.col("__name").rlike("^[0-9.]+$") | F.startswith(F.col("__name"), F.lit("["))
    wide = F.when(tail(2).isin(*LONG_SUFFIXES), 2).otherwise(1)
    return (
        hosts.withColumn("__name", name).withColumn("__parts", parts).withColumn("__wide", wide)
        .withColumns({
            "suffix": F.when(numeric, "").when(F.col("__wide") == 2, tail(2)).otherwise(tail(1)),
            "domain": F.when(numeric, F.col("__name")).when(F.col("__wide") == 2, tail(3))
            .otherwise(tail(2)),
        })
        .drop("__name", "__parts", "__wide")
    )


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: strength of the prior over groups ``(n, bad)`` from the spread of their rates."""
    p = F.col("b") / F.col("t")
    spread = (F.col("s") - F.col("t") * p * p) / F.col("t")     # weighted variance of rates
    noise = p * (1 - p) * F.col("g") / F.col("t")               # what binomial draws explain
    excess = (spread - noise) / (p * (1 - p))
    return (
        groups.filter("n > 0")
        .agg(F.sum("n").alias("t"), F.sum("bad").alias("b"), F.count("*").alias("g"),
             F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"))
        .select(F.lit(1).alias("__one"), F.coalesce(
            F.when((F.col("b") == 0) | (F.col("b") == F.col("t")), 100.0)
            .when(excess <= 0.001, 1000.0)
            .when(excess >= 0.5, 1.0)
            .otherwise((1 - excess) / excess), F.lit(1.0)).alias(name))
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame, url: str = "url") -> DataFrame:
    """One row per host of ``pages``: labelled pages, bad ones, posterior mean and lower bound.

    ``outcomes`` has ``page_id`` and ``bad`` (0 or 1). Levels above the host
    are sums of host rows, so pages are aggregated once, into a table in the
    shared folder.
    """
    hit = (
        outcomes.filter("bad is not null and page_id is not null").groupBy("page_id")
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    hosts = written(with_levels(
        with_host_and_path(pages.select("page_id", url), url).join(hit, "page_id", "left")
        .groupBy("host").agg(F.count("*").alias("pages"),
                             F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                             F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    ), "hosts")
    total = lambda df, keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, ["domain", "suffix"])
    suffixes = total(domains, ["suffix"])
    top = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1)
                        / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean0")).withColumn("__one", F.lit(1))
    one = top
    for level, groups in (("k1", suffixes), ("k2", domains), ("k3", hosts)):
        one = one.join(_strength(groups, level), "__one")
    shrunk = lambda mean, k: (F.col("bad") + F.col(k) * F.col(mean)) / (F.col("n") + F.col(k))
    suffix_means = (
        suffixes.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one")
        .select("suffix", shrunk("mean0", "k1").alias("mean1"), "k2", "k3")
    )
    domain_means = domains.join(suffix_means, "suffix").select(
        "domain", "suffix", shrunk("mean1", "k2").alias("mean2"), "k3")
    a = F.col("bad") + F.col("k3") * F.col("mean2")
    t = F.col("n") + F.col("k3")
    return hosts.join(domain_means, ["domain", "suffix"]).select(
        "host", "domain", "suffix", "pages", "n", "bad", (a / t).alias("bad_rate"),
        (a / t - SIGMAS * F.sqrt(a * (t - a) / (t * t * (t + 1)))).alias("bad_bound"))


def judge_pages(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (),
    max_bad: float = MAX_BAD, url: str = "url",
) -> DataFrame:
    """Every page with host, path, fitting rule, counts of its host and verdict.

    Host rows come back by an equi-join: broadcast when measured small, else
    the engine splits a hot host.
    """
    hosts = host_reputation(pages, outcomes, url).select(
        "host", F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"),
        (F.col("bad_bound") > max_bad).alias("__bad"))
    return (
        with_host_and_path(pages.select("page_id", url), url).join(hosts, "host", "left")
        .select("page_id", "host", "path", rule_column(rules).alias("rule"),
                F.coalesce(rule_column(rules, 2), F.when(F.col("__bad"), "block").otherwise("allow"))
                .alias("verdict"), "host_labelled", "host_bad")
    )
