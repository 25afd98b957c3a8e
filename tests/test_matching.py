"""Pattern search against plain ``re`` loops on small texts."""

import random
import re

import pytest

from runscope import catalogs
from runscope.functions.classify import CRITICAL_WORDS, HIGH_WORDS
from runscope.functions.guard import Guards
from runscope.operators import matching

TEXTS = {
    "c1/driver/stderr": "start\nERROR job 7\n failed\nx job 8 failed job 9 failed\n\n  OutOfMemoryError here  \nend",
    "c1/driver/stdout": "",
    "c1/executor/app.log": "\n\n\n",
    "c2/driver/log4j.log": "fatal\n\n error\nFATAL ERROR FATAL ERROR\tfatal error",
    "c2/x/unknown.txt": "été é fatal error déjà\n2024-05-01T10:11:12 permission denied\nlast line without end",
}


def expected(files, catalog):
    """(path, category, pattern, text, line, line number, context, position) by ``re``."""
    out = []
    for path, content in files.items():
        lines = content.split("\n")
        for category in catalogs.as_catalog(catalog):
            for pattern in category.patterns:
                for m in re.finditer(pattern, content, re.I | re.M):
                    number = content.count("\n", 0, m.start())
                    last = content.count("\n", 0, m.end())
                    out.append((
                        path, category.name, pattern, m.group(),
                        "\n".join(lines[number:last + 1]).strip(), number + 1,
                        "\n".join(lines[max(number - 2, 0):number + 3]), m.start(),
                    ))
    return sorted(out)


def found(df):
    return sorted(
        (r.file_path, r.category, r.pattern, r.matched_text, r.line, r.line_number, r.context, r.position)
        for r in df.collect()
    )


def test_whole_text_matches_equal_re(contents_of):
    got = matching.find_matches(contents_of(TEXTS))
    assert found(got) == expected(TEXTS, catalogs.SEARCH_CATALOG)
    assert any("\n" in row[3] for row in found(got))  # a match across lines


@pytest.mark.parametrize("pattern", [
    r"x*", r"(?=failed)", r"^[a-z]+", r"(?U)^\w+", r"\n", r"\s+", r"[^e]+", r"é", r"fatal error$", r".", r"\bjob\b.*",
])
def test_unusual_patterns_equal_re(contents_of, pattern):
    got = matching.find_matches(contents_of(TEXTS), {"any": [pattern]})
    plain = pattern.replace("(?U)", "")
    assert [(*r[:2], *r[3:]) for r in found(got)] == [
        (*r[:2], *r[3:]) for r in expected(TEXTS, {"any": [plain]})
    ]


def test_many_matches_cross_the_block_size(contents_of):
    files = {"c1/stderr": "\n".join(f"{i} task failed é" * (i % 3) for i in range(400))}
    got = matching.find_matches(contents_of(files), {"a": [r"task\s+failed"]})
    assert found(got) == expected(files, {"a": [r"task\s+failed"]})
    assert got.count() > 256


@pytest.mark.parametrize("seed", range(3))
def test_cap_equals_a_loop_over_files(contents_of, seed):
    rng = random.Random(seed)
    words = ["fatal error", "OutOfMemoryError", "ok", "job 3 failed", "permission denied", "task failed"]
    names = ["driver/stderr", "driver/stdout", "log4j.log", "executor/e.log", "driver/d.log", "a.gz", "zz"]
    files, modified = {}, {}
    for cluster in ("c1", "c2"):
        for i, name in enumerate(names * 2):
            path = f"{cluster}/r{i}/{name}"
            files[path] = "\n".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
            modified[path] = f"2024-01-0{rng.randint(1, 3)} 00:00:00"
    contents = contents_of(files, modified)
    cap = 4
    got = matching.search_error_patterns(contents, None, cap)
    types = {r.file_path: r.log_type for r in contents.collect()}
    order = ["stderr", "log4j", "driver", "executor", "stdout", "unknown"]
    paths = sorted(files)
    paths.sort(key=lambda p: modified[p], reverse=True)
    paths.sort(key=lambda p: order.index(types[p]) if types[p] in order else 99)
    kept = {}
    for path in paths:
        by_pattern = expected({path: files[path]}, catalogs.SEARCH_CATALOG)
        for category in catalogs.SEARCH_CATALOG:
            rows = [r for r in by_pattern if r[1] == category.name]
            rows.sort(key=lambda r: (category.patterns.index(r[2]), r[7]))
            have = kept.setdefault((path.split("/")[0], category.name), [])
            have += rows[:cap]
            del have[cap:]
    assert found(got) == sorted(r for rows in kept.values() for r in rows)
    assert any(len(rows) == cap for rows in kept.values())


def test_severity_words_and_categories(contents_of):
    lines = {
        "FATAL ERROR occurred": "critical",
        "OutOfMemoryError detected": "high",
        "connection refused": "low",
        "permission denied": "medium",
        "shuffle executor lost": "high",
    }
    files = {f"c1/{i}/stderr": line for i, line in enumerate(lines)}
    got = {r.line: r.severity for r in matching.find_matches(contents_of(files)).collect()}
    assert got == lines
    assert "fatal" in CRITICAL_WORDS and "severe" in HIGH_WORDS


def test_timestamp_of_the_line(contents_of):
    rows = matching.find_matches(contents_of(TEXTS)).filter("category = 'io_errors'").collect()
    assert [r.timestamp for r in rows] == ["2024-05-01T10:11:12"]


def test_invalid_pattern_is_reported_and_the_rest_runs(spark, contents_of):
    usable, rejected = catalogs.valid_patterns(
        spark, {"t": [r"[invalid regex", r"\bvalid\b"], "none": [r"("]}
    )
    assert [(r.category, r.pattern_idx, r.pattern) for r in rejected.collect()] == [
        ("t", 0, "[invalid regex"), ("none", 0, "(")
    ]
    got = matching.search_error_patterns(contents_of({"c1/a": "some valid text"}), usable)
    assert [r.matched_text for r in got.collect()] == ["valid"]


def test_custom_patterns_with_quotes_and_backslashes(contents_of):
    files = {"c1/a": "it's \\ here 'quoted'"}
    patterns = {"q": [r"'\w+'", r"\\", r"it's"]}
    got = matching.find_matches(contents_of(files), patterns)
    assert found(got) == expected(files, patterns)


def test_levels_stop_after_a_critical_hit(contents_of):
    contents = contents_of({
        "c1/stderr": "FATAL ERROR\njob 3 failed",
        "c2/stderr": "job 3 failed\njava.lang.OutOfMemory",
        "c3/stderr": "fine",
    })
    levels = {}
    for r in matching.search_by_level(contents).collect():
        levels.setdefault(r.cluster_id, set()).add(r.level)
    assert levels == {"c1": {1}, "c2": {2, 3}}
    summary = {(r.cluster_id, r.iteration): r.errors_found for r in matching.level_summary(contents).collect()}
    assert summary == {
        ("c1", 1): 1, ("c2", 1): 0, ("c2", 2): 1, ("c2", 3): 1,
        ("c3", 1): 0, ("c3", 2): 0, ("c3", 3): 0,
    }


def test_levels_without_repeats(contents_of):
    contents = contents_of({"c2/stderr": "job 3 failed"})
    rows = matching.search_by_level(contents, dedupe=True).collect()
    assert [(r.level, r.matched_text) for r in rows] == [(2, "job 3 failed")]


def test_guards_never_hide_a_match(contents_of):
    """Every built-in pattern is found in a sample made from its own text."""
    samples = {}
    everything = [*catalogs.ANALYSIS_CATALOG, *catalogs.SEARCH_CATALOG]
    for category in everything:
        for pattern in category.patterns:
            sample = pattern.replace("(?i)", "").replace(r"\b", "").replace(r"\.", ".")
            sample = re.sub(r"\(\?:([a-z]+)[^)]*\)", r"\1", sample)
            sample = sample.replace(r"[a-zA-Z0-9_.$]+", "a.b").replace(r"[a-zA-Z0-9_$]+", "c")
            sample = sample.replace(r"\n?", "").replace(r"\(", "(")
            for token, text in ((r"\s+", "  "), (r"\s*", ""), (r"\d+", "42"), (r"\w+", "w"), (".*", " x ")):
                sample = sample.replace(token, text)
            assert re.search(pattern, sample), (pattern, sample)
            samples[pattern] = sample.upper()
    files = {f"c1/{i}/stderr": text for i, text in enumerate(samples.values())}
    catalog = {"all": list(samples)}
    got = matching.pattern_counts(contents_of(files), catalog).collect()
    seen = {(r.file_path, r.pattern): r.matches for r in got}
    want = {
        (path, p): len(re.findall(p, text))
        for path, text in files.items() for p in samples if re.search(p, text)
    }
    assert seen == want
    guards = Guards(samples)
    assert 0 < len(guards.stems) < len(samples) / 2


def test_caps_may_be_lifted_and_must_fit_the_levels(contents_of):
    contents = contents_of({f"c1/{i}/stderr": "fatal error\n" * 9 for i in range(4)})
    free = matching.search_by_level(contents, caps=(None, None, None)).filter("level = 1 AND category = 'critical_errors'")
    capped = matching.search_by_level(contents, caps=(5, 5, 5)).filter("level = 1 AND category = 'critical_errors'")
    assert capped.count() == 5
    assert free.count() >= 36
    with pytest.raises(ValueError):
        matching.search_by_level(contents, caps=(5,))
