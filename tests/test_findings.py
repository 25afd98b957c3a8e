"""Severity, counts and examples follow all matches, whatever the caps of the levels show."""

from runscope.catalogs import LEVEL_CAPS
from runscope.operators import matching
from runscope.plans import diagnose

MILD = "no such file or directory\n"


def test_a_critical_line_behind_many_mild_ones_is_found(contents_of):
    contents = contents_of({"c1/stderr": MILD * 60 + "panic: no such file or directory"})
    stats = matching.category_stats(contents)
    got = {r.category: r for r in diagnose.findings(stats).collect()}["io_errors"]
    assert (got.severity, got["count"], got.critical_total) == ("critical", 1, 1)
    assert [(e.line_number, e.severity) for e in got.examples] == [(61, "critical")]
    old = diagnose.critical_findings(matching.search_by_level(contents, keep_order=True), matching.level_totals(contents))
    assert {r.category: (r.severity, r["count"]) for r in old.collect()}["io_errors"] == ("critical", 1)
    analysis = diagnose.smart_analysis(contents).first()
    assert [(f.category, f.severity, f["count"]) for f in analysis.critical_findings] == [("io_errors", "critical", 1)]
    shown = {b.category: (b.matches, b.matches_total) for b in analysis.error_breakdown}
    assert shown["io_errors"] == (50, 61) == (LEVEL_CAPS[1], 61) and analysis.errors_total > analysis.total_errors


def test_counts_go_beyond_the_caps(contents_of):
    contents = contents_of({f"c1/f{k}": "FATAL ERROR\n" * 30 for k in range(5)})
    row = diagnose.findings(matching.category_stats(contents)).filter("category = 'critical_errors'").first()
    assert (row.severity, row["count"], row.critical_total, len(row.examples)) == ("critical", 150, 150, 3)
    summary = matching.level_summary(contents).filter("iteration = 1").first()
    assert summary.errors_found == LEVEL_CAPS[0] < 150 <= summary.errors_total


def test_stats_equal_sums_over_all_matches(contents_of):
    files = {"c1/driver/stderr": MILD * 3 + "OutOfMemoryError: heap space\njob failed", "c1/x": "connection refused: failed",
             "c2/stdout": "FATAL ERROR\nsegmentation fault\n" * 4 + MILD, "c2/log4j": "fatal error: core dumped",
             "c3/a": "access denied\nnull pointer exception\nstage failed" * 9, "c4/a": "fine"}
    contents = contents_of(files)
    every = matching.search_by_level(contents, caps=(None, None, None), keep_order=True).collect()
    got = {(r.cluster_id, r.level, r.category): r for r in matching.category_stats(contents).collect()}
    groups = {}
    for r in every:
        groups.setdefault((r.cluster_id, r.level, r.category), []).append(r)
    assert set(got) == set(groups) and len(got) >= 3
    for key, rows in groups.items():
        rows.sort(key=lambda r: r.rn)
        row = got[key]
        for name, n in (("critical", 3), ("high", 2)):
            own = [r for r in rows if r.severity == name]
            assert row[f"{name}_total"] == len(own)
            assert [(e.file, e.line_number, e.line) for e in row[name] or []] == [
                (r.file, r.line_number, r.line) for r in own[:n]]
        assert row.matches_total == len(rows)
        assert row.memory_hits == any("outofmemory" in r.line.lower() and r.category == "critical_errors" for r in rows)


def test_advice_follows_all_matches(contents_of):
    contents = contents_of({"c1/stderr": "FATAL ERROR\n" * 40 + "java.lang.OutOfMemoryError"})
    rows = diagnose.recommendations(matching.category_stats(contents)).collect()
    assert "memory_issues" in {r.category for r in rows}
    assert len(diagnose.smart_analysis(contents).first().recommendations) == len(rows)


def test_nothing_found(contents_of):
    contents = contents_of({"c1/stderr": "all well"})
    assert diagnose.findings(matching.category_stats(contents)).collect() == []
    assert diagnose.smart_analysis(contents.limit(0)).collect() == []
    assert [r.errors_total for r in matching.level_summary(contents).collect()] == [0, 0, 0]
