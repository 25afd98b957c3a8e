"""Guards of patterns that need one of several words: fewer runs of the regex, the same counts."""

import re

from pyspark.sql import functions as F

from runscope.catalogs import alternative_words
from runscope.functions.guard import Guards, low_sql

TRACE = r"(?i)\b(?:exception|error|failure|fatal)\b.*\n?.*\bat\s+[a-zA-Z0-9_.$]+\.[a-zA-Z0-9_$]+\("
TEXTS = [
    None, "", "INFO worker handled view item 7", "ERROR nothing here", "look at a.b(c", "error\n    at com.example.Job.run(Job.java:42)",
    "Fatal AT x.y(", "FAILURE\n\nat a.b(", "terror at a.b(", "error bat a.b(", "an exception é at a.b( error at c.d(", "éerror at a.b(",
    "error at a.b(", "fatal\nat a.b(\nerror\nat c.d(",
]


def test_a_choice_of_words_is_tested_before_its_regex(spark):
    guards = Guards([TRACE, r"(?i)fatal\s+error", r"disk\s+failure"])
    asked = guards.sql("low", "flags", TRACE, f"regexp_count(t, '{TRACE}')")
    assert asked.startswith("if(") and "(?:exception" not in asked.split(" AND ")[0]
    count = "regexp_count(t, r'" + TRACE + "')"
    rows = (
        spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("low", F.expr(low_sql("t")))
        .withColumn("flags", F.expr(guards.flags_sql("low")))
        .select("t", F.expr(f"coalesce({guards.sql('low', 'flags', TRACE, count)}, 0)").alias("guarded"),
                F.expr(f"coalesce({count}, 0)").alias("plain"),
                F.expr(f"{guards.sql('low', 'flags', TRACE, 'true')} IS NOT NULL").alias("ran"))
        .collect()
    )
    assert [r.guarded for r in rows] == [r.plain for r in rows]
    assert sum(r.plain for r in rows) == 5
    ran = {r.t for r in rows if r.ran}
    assert ran == {t for t in TEXTS if t and re.search("exception|error|failure|fatal", t.lower()) and "at" in t.lower()}


def test_only_a_leading_choice_that_must_match_counts():
    assert alternative_words(TRACE) == (["exception", "error", "failure", "fatal"], ["at"])
    assert alternative_words(r"(?:AB|cd)\d+") == (["ab", "cd"], [])
    for pattern in (
        r"(?:ab|cd)?x", r"(?:ab|cd)*x", r"(?:ab|cd){0,2}x", r"(?:ab|cd)|ef", r"x(?:ab|cd)", r"(?:ab|c.)x", r"(?:ab|)x",
        r"(?:ab|cd)(?:\bat\s+)?", r"(?:ab|cd)\\bat\s+", r"(?iu)(?:ab|cd)", r"ab|cd", r"(?:ab|cd)\Q\bat\s+\E", r"(?:ab|cd)[|]",
    ):
        assert alternative_words(pattern) == ([], []), pattern
