"""Pattern search with the patterns in a table: any number of them, from anywhere.

The table has ``category``, ``pattern_idx`` and ``pattern``. Every pattern that
must contain some plain word is filed under a few letters of it; a text meets the
patterns whose letters occur in its words, by an equi-join of slim rows, and only
then the regexes run, over the candidates of each text. Patterns without such a
word are candidates everywhere.
"""

from __future__ import annotations

from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.functions.guard import low_sql
from runscope.functions.text import sql_text
from runscope.operators.matching import MATCH_COLUMNS, search_order, table_matches
from runscope.operators.ranking import cut_lineage, join_checked, top_n_per_group

GRAM = 4
PATTERN_COLUMNS = ("category", "pattern_idx", "pattern")
BATCH = 256         # patterns tried at once


def required_word(pattern: Column) -> Column:
    """The longest of the :func:`required_words`; null if none is known."""
    return F.get(required_words(pattern), F.lit(0))


def required_words(pattern: Column) -> Column:
    """All plain texts that every match must contain, lower-cased, the longest first; null if none is known.

    As :func:`runscope.catalogs.required_pieces` on a column: words joined by
    white space, digits, any text and plain alternations are understood. Letters
    beyond ASCII end a piece.
    """
    bare = F.lower(F.replace(F.replace(F.replace(pattern, F.lit("(?i)"), F.lit("")), F.lit(r"\b"), F.lit("")),
                             F.lit(r"\."), F.lit("\x00")))
    bare = F.regexp_replace(bare, r"\(\?:[a-z|]+\)", ".*")
    pieces = F.split(bare, r"\\s[+*]|\\d\+|\\w\+|\.\*|[^\x00-\x7f]+", -1)
    plain = F.forall(pieces, lambda p: p.rlike(r"\A[a-z0-9: \x00]*\z"))
    shown = F.filter(F.transform(pieces, lambda p: F.replace(p, F.lit("\x00"), F.lit("."))), lambda p: p != "")
    longest_first = F.reverse(F.array_sort(F.transform(
        F.array_distinct(shown), lambda p: F.struct(F.length(p).alias("n"), p.alias("word")))))
    return F.when(plain & (F.size(shown) > 0), F.transform(longest_first, lambda x: x.word))


def _filed_under(word: Column) -> Column:
    """The letters by which an index finds a word: from the middle of its longest run; '' if it is too short."""
    runs = F.transform(F.regexp_extract_all(word, F.lit("[a-z0-9]+"), F.lit(0)),
                       lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    best = F.array_max(runs)
    gram = F.substring(best["run"], ((best["n"] - GRAM) / 2).cast("int") + 1, F.lit(GRAM))
    return F.coalesce(F.when(best["n"] >= GRAM, gram), F.lit(""))


def checked_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, rejected)``: the table without the regexes that do not compile, and those with a reason.

    Distinct patterns pass through the driver in batches, where the planner folds
    them as literals: a batch with a bad one is halved until only that is left, and
    no task ever fails.
    """
    table = cut_lineage(patterns.select(*PATTERN_COLUMNS))
    spark = patterns.sparkSession
    bad: list[tuple[str, str]] = []
    rows = table.filter("pattern IS NOT NULL").select("pattern").distinct().toLocalIterator()
    while batch := [row["pattern"] for row in islice(rows, BATCH)]:
        bad += _broken(spark, batch)
    reasons = F.broadcast(spark.createDataFrame(bad, "pattern STRING, reason STRING")) if len(bad) <= BATCH \
        else spark.createDataFrame(bad, "pattern STRING, reason STRING")
    usable = table.join(reasons, "pattern", "left_anti").select(*PATTERN_COLUMNS)
    return usable, table.join(reasons, "pattern").select(*PATTERN_COLUMNS, "reason")


def _broken(spark: SparkSession, patterns: list[str]) -> list[tuple[str, str]]:
    try:
        spark.sql("SELECT 1").select(F.array(*[F.lit("").rlike(p) for p in patterns])).collect()
        return []
    except PySparkException as err:
        if len(patterns) == 1:
            return [(patterns[0], str(err).splitlines()[0] if str(err) else "invalid regex")]
    half = len(patterns) // 2
    return _broken(spark, patterns[:half]) + _broken(spark, patterns[half:])


def pattern_index(patterns: DataFrame) -> DataFrame:
    """The table with ``words`` and ``gram``, each pattern filed under one gram of its longest word."""
    rows = patterns.filter("pattern IS NOT NULL").withColumn("words", required_words(F.col("pattern")))
    return rows.select(*PATTERN_COLUMNS, "words", _filed_under(F.get("words", F.lit(0))).alias("gram"))


def _grams(low: str) -> Column:
    """All grams of the words of a text, and '' for the patterns that are filed nowhere."""
    return F.expr(
        f"concat(array(''), array_distinct(flatten(transform(array_distinct(regexp_extract_all({low}, "
        f"{sql_text(f'[a-z0-9]{{{GRAM},}}')}, 0)), w -> transform(sequence(1, length(w) - {GRAM - 1}), "
        f"i -> substring(w, i, {GRAM}))))))"
    )


def candidates(contents: DataFrame, index: DataFrame) -> DataFrame:
    """``cluster_id, file_path, candidates``: the patterns a file can match, as an array per file.

    What moves are (file, pattern) rows; a file's array is bounded by the table.
    """
    slim = contents.select("cluster_id", "file_path", F.expr(low_sql("content")).alias("low"))
    grams = slim.select("cluster_id", "file_path", F.explode_outer(_grams("low")).alias("gram"))
    met = join_checked(grams, index, ["gram"], width=sum(
        (F.coalesce(F.length(c), F.lit(0)) for c in ("category", "pattern", F.array_join("words", ""))), F.lit(16)))
    return met.groupBy("cluster_id", "file_path").agg(F.array_sort(F.collect_list(
        F.struct("category", "pattern_idx", "pattern", "words"))).alias("candidates"))


def find_table_matches(contents: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every match of every pattern of the table: the rows of ``find_matches`` with a literal catalog.

    A regex that does not compile fails the job; see :func:`checked_patterns`.
    Runs jobs while it is called, to measure what is broadcast.
    """
    found = candidates(contents, cut_lineage(pattern_index(patterns)))
    size = F.aggregate("candidates", F.lit(0), lambda a, c: a + 16 + F.length(c.category) + 2 * F.length(c.pattern))
    texts = join_checked(contents, found, ["cluster_id", "file_path"], width=size)
    return table_matches(texts).select(*MATCH_COLUMNS)


def search_table(contents: DataFrame, patterns: DataFrame, max_per_category: int | None = 50) -> DataFrame:
    """First ``max_per_category`` matches per (cluster, category) of the patterns of a table."""
    keys = ["cluster_id", "file_path"]
    found = find_table_matches(contents, patterns)
    if max_per_category is None:
        return found
    dated = join_checked(found, contents.select(*keys, "last_modified"), keys)
    return top_n_per_group(
        dated, ["cluster_id", "category"], search_order(), max_per_category, ["file_path"]
    ).select(*MATCH_COLUMNS)
