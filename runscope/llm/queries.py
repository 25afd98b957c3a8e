"""The operators of this package bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import (
    histogram_packing,
    jaccard_join,
    licenses,
    packing,
    pieces,
    prefix_trie,
    quality_rules,
    sharding,
    token_files,
    toxicity,
    url_reputation,
    vector_codes,
    vector_search,
)
from runscope.llm.common import held_out, table, written
from runscope.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rules for op2: (host, start of the path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Where the machine keeps the vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark, sf_dir):
    return licenses.license_places(table(spark, sf_dir, "documents"))


@query
def op2_url_reputation(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge_pages(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query
def op4_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


@query
def op5_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign(docs, "doc_id", fallback="source")


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.packed_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op7_sampled_pieces(spark, sf_dir):
    found = pieces.sampled_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op9_token_files(spark, sf_dir):
    read = token_files.written_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_quality_rules(spark, sf_dir):
    base = quality_rules.with_base_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    base = written(base.drop("text"), "base-rules")
    judged = quality_rules.judge(base, quality_rules.host_verdicts(base))
    return judged.select("doc_id", *quality_rules.METRICS, "kept")


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op12_packing(spark, sf_dir):
    found = histogram_packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_vector_codes(spark, sf_dir):
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
