"""Files read in blocks and as lines against the same files as whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from runscope.catalogs import SEARCH_CATALOG
from runscope.operators import chunking, matching, oversize
from runscope.sources import files
from runscope.sources.tables import ERROR_MESSAGES

PATTERNS = {
    "spanning": [r"a\n", r"(?:a+\s){2}", r"\s+", r"Table\s+or", r"failed[a-z :]*\n.*\nTable"],
    "edges": [r"^a", r"a$", r"\ba", r"\bor\b", r"a*"],
}
QUICK = dict(block_chars=200, halo_lines=8, group_lines=8)


def long_text(seed, lines):
    rng = random.Random(seed)
    words = ["aa", "aaa a", "x failed", "Table", "or view not found", "aé ß", "it aa", "\t"]
    out = []
    for _ in range(lines):
        r = rng.random()
        out.append(rng.choice(ERROR_MESSAGES) if r < 0.3 else "" if r < 0.35 else rng.choice(words))
    return "\n".join(out)


@pytest.fixture(scope="module")
def texts():
    return {"c1/driver/stderr": long_text(1, 500), "c1/x": long_text(2, 300) + "\n", "c2/a": "aaaa\n" * 100,
            "c2/empty": "", "c3/wide": ("a" * 500 + "\n") * 12, "c3/one": "ERROR panic"}


def lines_of(contents):
    return contents.select(
        *chunking.FILE_COLUMNS, F.posexplode(F.split("content", "\n", -1)).alias("n", "line")
    ).withColumn("line_number", F.col("n") + 1).drop("n")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("patterns", [SEARCH_CATALOG, PATTERNS], ids=["catalog", "own"])
@pytest.mark.parametrize("size", [dict(block_chars=60, halo_lines=8, group_lines=8), QUICK,
                                  dict(block_chars=65536, halo_lines=32, group_lines=64)])
def test_blocks_give_the_matches_of_whole_texts(contents_of, texts, patterns, size):
    contents = contents_of(texts)
    blocks = oversize.log_blocks(lines_of(contents), **size)
    found = matching.find_block_matches(blocks, patterns)
    assert rows(found.select(*matching.MATCH_COLUMNS)) == rows(matching.find_matches(contents, patterns))


def test_no_block_holds_a_file(contents_of, texts):
    blocks = oversize.log_blocks(lines_of(contents_of(texts)), **QUICK)
    wide = max(len(t) for line in texts.values() for t in line.split("\n"))
    assert blocks.filter(F.length("content") > 200 + 17 * (wide + 1)).isEmpty()
    assert blocks.groupBy("file_path").count().filter("count > 20").count() >= 2


def test_a_match_that_runs_over_several_borders(contents_of):
    contents = contents_of({"c/f": "\n".join(["ab"] * 7 + ["aaaa aaaa", "aa"] * 20)})
    pattern = {"p": [r"(?:a+\s+){5}", r"a\sa"]}
    blocks = oversize.log_blocks(lines_of(contents), 10, 8, 8)
    found = matching.find_block_matches(blocks, pattern)
    assert rows(found.select(*matching.MATCH_COLUMNS)) == rows(matching.find_matches(contents, pattern))


def test_matches_that_reach_the_end_of_a_halo_are_marked(contents_of):
    contents = contents_of({"c/f": "\n" * 200})
    found = matching.find_block_matches(oversize.log_blocks(lines_of(contents), 20, 8, 8), {"p": [r"\s+"]})
    assert found.filter("cut_by_halo").count() > 0


def test_capped_search_over_files_and_blocks(contents_of, texts):
    whole = contents_of(texts)
    small = whole.filter("length(content) < 900")
    blocks = oversize.log_blocks(lines_of(whole.filter("length(content) >= 900")), **QUICK)
    for cap in (3, None):
        found = matching.search_error_patterns(small, None, cap, blocks=blocks)
        assert rows(found) == rows(matching.search_error_patterns(whole, None, cap))


@pytest.mark.parametrize("query", [None, "aa"])
def test_chunks_of_lines_are_the_chunks_of_texts(contents_of, texts, query):
    contents = contents_of(texts | {"c4/blank": "\n" * 40 + "error\n" + " \n" * 30 + "fatal"})
    lines = lines_of(contents).repartition(5)
    want = chunking.log_chunks(contents, query, 7)
    assert rows(oversize.line_chunks(lines, query, 7).select(*want.columns)) == rows(want)
    top = chunking.top_chunks(contents, 4, query, 7)
    assert rows(oversize.top_line_chunks(lines, 4, query, 7).select(*top.columns)) == rows(top)


def test_oversize_files_on_disk_have_the_lines_of_their_texts(spark, tmp_path):
    wanted = {"c1/plain.log": b"one\ntwo\n", "c1/open.log": b"one\ntwo", "c2/cr.log": b"one\r\ntwo\r\n\r\n",
              "c2/blank.log": b"\n\n", "c3/bad.log": b"good\n\xff\xfe\n", "c3/small.log": b"x"}
    for name, data in wanted.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root, cap = str(tmp_path), 1 / files.MB
    found = files.oversize_lines(spark, root, cap)
    want = files.lines_of(files.log_contents(spark, root).filter("size > 1"))
    columns = ["cluster_id", "file_path", "line_number", "line"]
    assert rows(found.select(*columns)) == rows(want.select(*columns))
    assert found.filter("file_path LIKE '%bad%'").isEmpty()
    assert files.oversize_lines(spark, root, 1).isEmpty()


def test_blocks_of_nothing(contents_of):
    none = lines_of(contents_of({"c/f": "x"})).filter("false")
    assert matching.find_block_matches(oversize.log_blocks(none)).collect() == []
    assert oversize.line_chunks(none).collect() == []


def test_halo_must_fit_into_a_group(contents_of):
    with pytest.raises(ValueError, match="halo_lines"):
        oversize.log_blocks(lines_of(contents_of({"c/f": "x"})), 100, 9, 8)
