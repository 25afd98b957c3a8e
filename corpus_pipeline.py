"""From raw documents to packed training sequences in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept; ``run`` writes every stage as Parquet in the shared folder and
reads it again, so a lost executor repeats parts of one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import jaccard_join, packing, quality_rules, toxicity
from runscope.llm.common import table, written
from runscope.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their hosts' rates keep.

    Failures are counted per host in a first pass; the second pass judges rows
    where they are read, and only rejected hosts are joined, so texts stay put.
    """
    base = quality_rules.with_base_rules(docs.select("source", "text"))
    bad = quality_rules.host_verdicts(base.select("source", "base_failed")).filter("host_rejected").select("host")
    bad = written(bad, "rejected-hosts").withColumnRenamed("host", "__host")
    few = F.broadcast(bad) if jaccard_join.fits_broadcast(bad) else bad
    judged = quality_rules.with_base_rules(docs.withColumn("__row", F.struct(*[f"`{c}`" for c in docs.columns])))
    kept = judged.filter(~F.col("base_failed")).select("__row.*")
    return kept.join(few, kept["source"] == F.col("__host"), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score lies below the cut, learned from the labels of what came here."""
    model, weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), "text")
    return toxicity.scores(held, model, weights).filter(F.col("score") < toxicity.CUT).select("__row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.packed_digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packed),
]

# Learned scores and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
