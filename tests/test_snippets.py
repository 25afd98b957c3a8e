"""Snippets against texts written by hand."""

import pytest

from runscope.operators import snippets

STOCK = "load\nError in row 7\nskip\nskip\nerror again\nend"


def only(contents_of, content, *args):
    found = snippets.context_snippets(contents_of({"c1/stderr": content}), *args).collect()
    return [(r.matches, r.lines_matched) for r in found]


@pytest.mark.parametrize("around,want", [
    (0, ">>>    2: Error in row 7\n---\n>>>    5: error again\n---"),
    (1, "       1: load\n>>>    2: Error in row 7\n       3: skip\n---\n"
        "       4: skip\n>>>    5: error again\n       6: end\n---"),
])
def test_hits_are_marked_inside_their_context(contents_of, around, want):
    assert only(contents_of, STOCK, "error", 50, around) == [(want, 2)]


def test_long_results_are_cut_but_all_hits_count(contents_of):
    (shown, hits), = only(contents_of, STOCK, "error", 1, 1)
    assert hits == 2
    assert shown == "       1: load\n>>>    2: Error in row 7"


def test_files_without_hits_give_no_row(contents_of):
    assert only(contents_of, STOCK, "nothing", 5, 5) == []
    assert only(contents_of, "", "x", 5, 5) == []


def test_empty_pattern_hits_every_line(contents_of):
    (_, hits), = only(contents_of, STOCK, "", 50, 1)
    assert hits == 6


def test_head_snippets(contents_of):
    files = {"c1/a": "\n".join(f"l{i}" for i in range(12000)), "c1/b": "x"}
    got = {r.file_path: r.snippet for r in snippets.head_snippets(contents_of(files), 11000).collect()}
    lines = [f"{i + 1:4d}: l{i}" for i in range(11000)]
    assert got == {"c1/a": "\n".join(lines), "c1/b": "   1: x"}


def test_types_and_totals(contents_of):
    contents = contents_of({"c1/stderr": "a\na", "c1/stdout": "a", "c2/stdout": "b"})
    only = snippets.search_log_pattern(contents, "A", ["stdout"]).collect()
    assert [r.file_path for r in only] == ["c1/stdout"]
    totals = [tuple(r) for r in snippets.pattern_totals(contents, "a").collect()]
    assert totals == [("c1", 2, 3)]
