"""Quality rules on documents and on the hosts they come from.

Built-in functions only. Every rule is computed inside the row of its document,
so nothing but counts per host and slim rows is ever shuffled.

Defined results: a null text has no words and fails; a null host has no verdict,
so base rules alone decide; repeated rows are judged row by row; an empty table
gives an empty table; columns that clash with results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import WHITE, without, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_MAX_FAILURE = 0.5   # a host is rejected if its failure rate lies above this ...
HOST_SIGMAS = 2.0        # ... by so many posterior standard deviations
BROADCAST_HOSTS = 200_000
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _window(words: Column, word: Column, i: Column) -> list[Column]:
    return [word, *(F.get(words, i + k) for k in range(1, WINDOW))]


def with_base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics of each text and ``base_failed``.

    Words in repeated windows: windows are first compared by hash, which is
    enough where all differ; only texts with equal hashes sort their windows as
    strings, so the count is exact.
    """
    df = without(df, METRICS)
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")
    out = (
        df.withColumn("__body", body)
        .withColumn("__words", F.array_remove(
            F.split(F.translate("__body", WHITE, " " * len(WHITE)), " ", -1), ""))
        .withColumn("__lines", F.filter(
            F.split("__body", "\n", -1), lambda x: F.translate(x, WHITE, "") != ""))
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.translate("__body", WHITE, "")).cast("long"),
            "n_symbols": (F.char_length("__body")
                          - F.char_length(F.translate("__body", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        })
    )
    words = F.col("__words")
    starts = F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0)).cast("int"))
    out = out.withColumn("__hashes", F.transform(
        starts, lambda w, i: F.xxhash64(*_window(words, w, i))))
    # strings in order, so that equal windows are neighbours; null where all windows differ
    out = out.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
        F.sort_array(F.transform(starts, lambda w, i: F.struct(
            F.concat_ws(" ", *_window(words, w, i)).alias("g"), i.alias("i"))))))
    ordered = F.col("__sorted")
    out = out.withColumn("__found", F.sort_array(F.transform(
        F.filter(ordered, lambda x, k: F.coalesce(x.g == F.get(ordered, k + 1).g, F.lit(False))
                 | F.coalesce((k > 0) & (x.g == F.get(ordered, k - 1).g), F.lit(False))),
        lambda x: x.i)))
    found = F.col("__found")
    covered = F.aggregate(
        F.transform(found, lambda x, k: F.coalesce(
            F.least(F.get(found, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda a, x: a + x)
    return (
        out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        # The id is never negative. As it is not deterministic, a later filter stays above this
        # step; pushed down, it would copy the work on texts into itself many times over.
        .withColumn("base_failed", (F.monotonically_increasing_id() < 0) | (n < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
        .drop("__body", "__words", "__lines", "__hashes", "__sorted", "__found")
    )


def host_verdicts(base: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: counts, shrunken failure rate and ``host_rejected``.

    The prior is a beta distribution whose mean and strength come from the
    spread of the rates of all hosts (method of moments); a host with few
    documents stays close to the mean of all. One host alone shows no spread,
    so its prior weighs no more than one document. The prior is one row.
    """
    hosts = (
        base.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    rate = F.col("failed") / F.col("n")
    mean = (F.sum("failed") + 1) / (F.sum("n") + 2)
    spread = F.coalesce(F.var_pop(rate), F.lit(0.0))
    prior = hosts.agg(mean.alias("prior_mean"), spread.alias("spread"), F.count("*").alias("hosts")).select(
        "prior_mean",
        F.when(F.col("hosts") < 2, 1.0).when(F.col("spread") > 1e-9, F.greatest(F.lit(1.0), F.least(
            F.lit(1000.0), F.col("prior_mean") * (1 - F.col("prior_mean")) / F.col("spread") - 1)))
        .otherwise(1000.0).alias("prior_n"),
    )
    a = F.col("failed") + F.col("prior_n") * F.col("prior_mean")
    total = F.col("n") + F.col("prior_n")
    sd = F.sqrt(a * (total - a) / (total * total * (total + 1)))
    # one row of prior to every host, by the constant key 1
    return (
        hosts.withColumn("__one", F.lit(1))
        .join(F.broadcast(prior.withColumn("__one", F.lit(1))), "__one")
        .select("host", "n", "failed", (a / total).alias("rate"),
                (a / total - HOST_SIGMAS * sd > HOST_MAX_FAILURE).alias("host_rejected"))
    )


def judge(base: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """``base`` with ``kept``: the base rules hold and the host is not rejected.

    Only rejected hosts are joined. They are counted first and broadcast if
    they are few, so a hot host stays where its rows are; many are joined by a
    shuffle, where the engine splits a hot host.
    """
    bad = written(hosts.filter("host_rejected").select(
        F.col("host").alias("__host"), F.lit(True).alias("__bad")), "rejected-hosts")
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return (
        without(base, ["kept"]).join(F.broadcast(bad) if few else bad, F.col(host) == F.col("__host"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull())
        .drop("__host", "__bad")
    )
