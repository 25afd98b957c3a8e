"""Patterns from a table against the same patterns as a literal catalog."""

import random

import pytest
from pyspark.sql import functions as F

from runscope.catalogs import SEARCH_CATALOG, required_text
from runscope.operators import matching, pattern_tables

DDL = "category STRING, pattern_idx INT, pattern STRING"


def table_of(spark, catalog):
    return spark.createDataFrame([(c, i, p) for c, own in catalog.items() for i, p in enumerate(own)], DDL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(9)
    return ["".join(rng.choice("abcdeloprstu") for _ in range(rng.randint(2, 9))) for _ in range(1500)]


@pytest.fixture(scope="module")
def catalog(words):
    """2,000 regexes: words in spacing, parts of words, groups, and some without any plain word."""
    rng = random.Random(10)
    own = {"pairs": [], "parts": [], "free": []}
    for _ in range(1400):
        own["pairs"].append(r"\s+".join(rng.choice(words) for _ in range(2)))
    for _ in range(590):
        word = rng.choice(words)
        own["parts"].append(rng.choice([word[1:], rf"\b{word}\b", rf"{word}.*{word[:3]}", rf"(?:{word}|xx)\s*{word[:4]}"]))
    own["free"] = [r"\d{3}", r"[A-Z]\w+é", r"x|y+z", "é\\s+deux", r"^$", r"a{4}", r"deux\s+été", "ab", r"q.", r"İ"]
    return own


@pytest.fixture
def texts(contents_of, words):
    rng = random.Random(11)
    files = {}
    for k in range(60):
        line = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(12)]
        line[3] = line[3].upper()
        files[f"c{k % 5}/f{k}"] = "\n".join(line) + ("\nÀ é  deux été 123 aaaa xyz İx" if k % 7 == 0 else "")
    return contents_of(files | {"c9/empty": "", "c9/none": "\n\n"})


def test_two_thousand_patterns_give_the_rows_of_a_literal_catalog(spark, texts, catalog):
    found = pattern_tables.find_table_matches(texts, table_of(spark, catalog))
    want = rows(matching.find_matches(texts, {c: own for c, own in catalog.items() if c != "pairs"}))
    # pairs of words are checked by a plain join of the guarded form, which is much faster to plan
    for at in range(0, 1400, 200):
        want += [r[:5] + (r[5] + at,) + r[6:] for r in rows(
            matching.find_matches(texts, {"pairs": catalog["pairs"][at:at + 200]}))]
    assert rows(found) == sorted(want, key=repr)
    assert len(want) > 500


def test_texts_meet_patterns_without_a_nested_loop(spark, texts, catalog):
    plan = pattern_tables.find_table_matches(texts, table_of(spark, catalog))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_patterns_are_candidates(spark, texts, catalog):
    index = pattern_tables.pattern_index(table_of(spark, catalog))
    free = index.filter("gram = ''").count()
    assert free < 400        # words of two and three letters, and ten regexes
    most = pattern_tables.candidates(texts, index).agg(F.max(F.size("candidates"))).first()[0]
    assert most < 1000


def test_capped_search_equals_the_literal_one(spark, texts):
    catalog = {c.name: c.patterns for c in SEARCH_CATALOG} | {"words": [r"\w+\s+\w+"]}
    found = pattern_tables.search_table(texts, table_of(spark, catalog), 4)
    assert rows(found) == rows(matching.search_error_patterns(texts, catalog, 4))
    assert rows(pattern_tables.search_table(texts, table_of(spark, catalog), None)) == rows(matching.find_matches(texts, catalog))


def test_required_word_is_that_of_the_driver(spark):
    patterns = [p for c in SEARCH_CATALOG for p in c.patterns] + ["a|b", r"x\.y", r"(?:a|b)c+", "", "né tot", r"A\s+Bc\d+d"]
    got = spark.createDataFrame([(p,) for p in patterns], "p STRING").select(
        "p", pattern_tables.required_word(F.col("p")).alias("w")).collect()
    for p, word in got:
        want = required_text(p)
        assert (len(word or "") == len(want or "")) or not p.isascii(), p
        assert word is None or want is None or not p.isascii() or word in p.lower().replace("\\.", ".")


def test_broken_patterns_are_rows_with_a_reason(spark):
    given = [("a", 0, "[x"), ("a", 1, "ok"), ("b", 0, "(?<n"), ("b", 1, "[x"), ("b", 2, None)]
    given += [("c", k, f"fine{k}") for k in range(600)] + [("d", 0, "*")]
    usable, rejected = pattern_tables.checked_patterns(spark.createDataFrame(given, DDL))
    assert sorted((r.category, r.pattern_idx, r.pattern) for r in rejected.collect()) == [
        ("a", 0, "[x"), ("b", 0, "(?<n"), ("b", 1, "[x"), ("d", 0, "*")]
    assert all(r.reason for r in rejected.collect())
    assert usable.count() == 602


def test_tables_without_rows(spark, texts):
    none = spark.createDataFrame([], DDL)
    assert pattern_tables.find_table_matches(texts, none).collect() == []
    usable, rejected = pattern_tables.checked_patterns(none)
    assert usable.isEmpty() and rejected.isEmpty()
    assert pattern_tables.find_table_matches(texts.limit(0), table_of(spark, {"a": ["b"]})).collect() == []


def test_all_words_of_a_pattern_guard_it_and_are_looked_for_in_one_lowered_text(spark):
    index = pattern_tables.pattern_index(table_of(spark, {"p": [r"so\s+called\s+it", r"[0-9]+"]}))
    assert {r.pattern: r.words for r in index.collect()} == {r"so\s+called\s+it": ["called", "so", "it"], r"[0-9]+": None}
    texts = spark.createDataFrame(
        [("c", f"c/{i}", "stderr", t, [("p", 0, r"so\s+called\s+it", ["called", "so", "it"])])
         for i, t in enumerate(["So  Called it", "called it"])],
        "cluster_id STRING, file_path STRING, log_type STRING, content STRING, "
        "candidates ARRAY<STRUCT<category: STRING, pattern_idx: INT, pattern: STRING, words: ARRAY<STRING>>>").selectExpr(
        "*", "'f' AS file_name", "0L AS size", "timestamp_ntz'2024-01-01' AS last_modified")
    found = matching.table_matches(texts)
    assert [r.matched_text for r in found.collect()] == ["So  Called it"]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(lambda low" in plan and "contains(regexp_replace" not in plan
