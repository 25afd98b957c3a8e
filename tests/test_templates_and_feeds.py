"""Line templates, totals of rounds, and files that arrive in waves."""

import gzip
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runscope.operators import matching, templates
from runscope.plans import analysis
from runscope.sources import files
from runscope.streaming import feeds


def as_lines(spark, rows):
    return spark.createDataFrame(rows, "cluster_id STRING, file_path STRING, line_number INT, line STRING")


def plain_templates(lines, depth, wide):
    """The definition with dictionaries; ``lines`` are masked already."""
    node = {line: (len(line.split(" ")),) for line in set(lines)}
    for level in range(depth):
        children = {}
        for line, at in node.items():
            words = line.split(" ")
            if level < len(words):
                children.setdefault(at, set()).add(words[level])
        node = {line: at if level >= len(line.split(" ")) else
                (*at, templates.ANY if len(children[at]) > wide else line.split(" ")[level]) for line, at in node.items()}
    leaves = {}
    for line, at in node.items():
        leaves.setdefault(at, []).append(line.split(" "))
    counts = Counter(node[line] for line in lines)
    return sorted((" ".join([*at[1:], *(p[0] if len(set(p)) == 1 else templates.ANY for p in list(zip(*own))[depth:])]),
                   counts[at], len(own)) for at, own in leaves.items())


@pytest.mark.parametrize("depth,wide", [(0, 1), (1, 3), (2, 2), (4, 20)])
def test_templates_equal_the_definition(spark, depth, wide):
    names = ["ann", "bob", "cy", "dee"]
    texts = [f"user {names[i % 4]} lost {'a' if i % 3 else 'the'} lease" for i in range(40)]
    texts += [f"{w} went away" for w in names] + ["lone", "lone", "so  it\tis"]
    got = templates.line_templates(as_lines(spark, [("c1", "f", i, t) for i, t in enumerate(texts)]), depth, wide)
    want = plain_templates([" ".join(t.split()) for t in texts], depth, wide)
    assert sorted((r.template, r.lines, r.distinct_lines) for r in got.collect()) == want


def test_variable_parts_are_masked_and_examples_are_the_first(spark):
    rows = [("c2", "b", 1, "2024-01-01 10:00:00 disk /mnt/a1 at 91.5 is slow"), ("c1", "a", 7, "2024-02-02 11:00:00,123 disk /mnt/b at 7 is slow"),
            ("c1", "a", 9, "lease 0xFF12 of 123e4567-e89b-12d3-a456-426614174000 lost"), ("c1", "a", 10, None), ("c1", "a", 11, " \t"),
            ("c1", "a", 12, "")]
    got = {r.template: r for r in templates.line_templates(as_lines(spark, rows).withColumn("node", F.lit("x"))).collect()}
    assert set(got) == {"<time> disk <path> at <num> is slow", "lease <id> of <id> lost"}
    first = got["<time> disk <path> at <num> is slow"]
    assert (first.lines, first.clusters, first.words, first.example_file, first.example_number) == (2, 2, 7, "a", 7)
    assert templates.line_templates(as_lines(spark, [])).collect() == []


def test_lines_that_a_match_touches_are_not_left(spark, contents_of):
    contents = contents_of({"c1/a": "one\nFATAL ERROR here\n\nshuffle\nfetch failed: x\nodd failure\n", "c2/a": "", "c3/a": None})
    got = matching.unmatched_lines(contents, {"mine": [r"FATAL ERROR", r"shuffle\s+fetch"]})
    assert [tuple(r) for r in got.orderBy("line_number").collect()] == [("c1", "c1/a", 1, "one"), ("c1", "c1/a", 6, "odd failure")]
    some = matching.unmatched_lines(contents, {"mine": [r"FATAL ERROR"]}, r"(?i)\bfail(ed|ure)\b")
    assert [r.line_number for r in some.orderBy("line_number").collect()] == [5, 6]


def test_totals_of_rounds_count_chunks_that_no_round_keeps(spark, contents_of):
    text = "\n".join(["ERROR java.lang.OutOfMemoryError: Java heap space"] * 30 + ["connection refused"] * 7)
    row = analysis.analyze_iteratively(contents_of({"c1/stderr": text, "c1/b": "fine"}), None, 3, 1).first()
    totals = {e.error_type: e.frequency_total for e in row.category_totals}
    assert totals["memory_errors"] == 30
    memory = next(e for e in row.error_summary if e.error_type == "memory_errors")
    assert (memory.frequency, memory.frequency_total) == (5, 30)        # critical, so one round of five chunks
    assert row.iteration_breakdown[0].frequency_total == sum(totals.values())
    every = analysis.error_summary(contents_of({"c1/stderr": text, "c1/b": "fine"}), None, 1)
    whole = {r.error_type: r.frequency for r in every.collect()}
    assert totals == {name: whole[name] for name in totals}


def test_files_in_waves_are_reported_once(spark, tmp_path):
    root, place = tmp_path / "in", str(tmp_path / "place")
    (root / "c1").mkdir(parents=True)
    layout = r"([^/]+)/([^/]+)$"
    assert feeds.fed_files(spark, place).isEmpty() and feeds.fed_matches(spark, place).isEmpty()
    (root / "c1" / "good").write_text("FATAL ERROR a\n")
    (root / "c1" / "bytes").write_bytes(b"FATAL ERROR \xff\n")
    (root / "c1" / "cut.gz").write_bytes(gzip.compress(b"FATAL ERROR " + bytes(range(65, 91)) * 2000)[:60])
    (root / "stray").write_text("FATAL ERROR b\n")
    patterns = {"mine": [r"FATAL\s+ERROR"]}

    def take():
        feeds.take_in_files(spark, str(root), place, patterns, 0.001, layout, 2)
        return (sorted((r.file_name, r.outcome) for r in feeds.fed_files(spark, place).filter("cluster_id <> ''").collect()),
                sorted((r.file, r.line) for r in feeds.fed_matches(spark, place).collect()))

    seen, found = take()
    assert seen == [("bytes", "not_utf8"), ("cut.gz", "unreadable"), ("good", "read")] and found == [("good", "FATAL ERROR a")]
    assert take() == (seen, found)
    (root / "c1" / "later").write_text("x\nFATAL ERROR c\n")
    (root / "c1" / "large").write_text("FATAL ERROR\n" * 500)
    seen, found = take()
    assert seen == [("bytes", "not_utf8"), ("cut.gz", "unreadable"), ("good", "read"), ("large", "too_large"), ("later", "read")]
    assert found == [("good", "FATAL ERROR a"), ("later", "FATAL ERROR c")]
    assert [r.outcome for r in feeds.fed_files(spark, place).filter("cluster_id = ''").collect()] == ["off_layout"]
    batch = files.rejected_files(spark, str(root), 0.001, layout=layout).filter("cluster_id <> ''")
    assert {(r.file_path.rsplit("/")[-1], r.reason) for r in batch.collect()} == {s for s in seen if s[1] != "read"}


def test_a_line_is_masked_once(spark):
    lines = as_lines(spark, [("c1", "f", 1, "disk 7"), ("c1", "f", 2, " "), ("c1", "f", 3, None)])
    counted = templates._masked_lines(lines).groupBy("masked", "cluster_id").count()
    assert [tuple(r) for r in counted.collect()] == [("disk <num>", "c1", 1)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<path>") == 1
