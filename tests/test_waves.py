"""Files that are too many for one listing, and few folders for many written files."""

import gzip

import pytest
from pyspark.sql import functions as F

from runscope.sources import files

TEXTS = {"plain": b"one\ntwo\n", "open": b"one\ntwo", "dos": b"a\r\nb\r\n", "bad": b"good\n\xff\n", "packed.gz": gzip.compress(b"x\ny\n"),
         "cut.gz": gzip.compress(b"error " * 4000)[:40], "blank": b"\n\n", "mark": b"\xef\xbb\xbfa\n", "long": b"l\n" * 3000, "empty": b""}
CAP = 3 / files.MB
READERS = {
    "inventory": lambda spark, root: files.log_inventory(spark, root, off_layout=True),
    "contents": lambda spark, root: files.log_contents(spark, root),
    "capped": lambda spark, root: files.log_contents(spark, root, CAP, ["unknown"]),
    "rejects": lambda spark, root: files.rejected_files(spark, root, 1000 / files.MB),
    "lines": lambda spark, root: files.log_lines(spark, root),
    "oversize": lambda spark, root: files.oversize_lines(spark, root, CAP),
}


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    base = tmp_path_factory.mktemp("waves")
    for i in range(40):
        at = base / f"c[{i}]%20" / "driver"
        at.mkdir(parents=True)
        for name, data in TEXTS.items():
            (at / name).write_bytes(data)
    (base / "stray").write_text("lost\n")
    for hidden in ("_temporary", ".kept"):
        (base / hidden).mkdir()
        (base / hidden / "log").write_text("no\n")
    return str(base)


@pytest.mark.parametrize("name", READERS)
def test_waves_give_the_rows_of_one_listing(spark, many, monkeypatch, name):
    def rows(df):
        return sorted(map(tuple, df.withColumns({c: F.col(c).cast("binary") for c in ("line", "content") if c in df.columns}).collect()),
                      key=repr)

    want, listed, load = READERS[name](spark, many), [], files._listed
    monkeypatch.setattr(files, "FILES_A_WAVE", 60)
    monkeypatch.setattr(files, "FIRST_FOLDERS", 4)

    def watched(*args, **options):
        raw = load(*args, **options)
        listed.append(len(files._names_of(raw)))
        return raw

    monkeypatch.setattr(files, "_listed", watched)
    before = {x: spark.conf.get(x) for x in (files.LISTING_LIMIT, files.LISTED_BY_DRIVER, files.OPEN_COST)}
    got = READERS[name](spark, many)
    assert max(listed) <= 120 and sum(listed) >= 40 * (len(TEXTS) - 1)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes and not got.isEmpty()
    assert {x: spark.conf.get(x) for x in before} == before


def test_gzip_is_unpacked_as_by_the_engine(spark, tmp_path, monkeypatch):
    one, two = gzip.compress(b"a\n" * 50), gzip.compress("é".encode())
    odd = {"members": one + two, "nothing": gzip.compress(b""), "garbage": one + b"garbage", "zeros": one + bytes(20), "cut": one + two[:9],
           "no_end": one[:-4], "wrong_sum": one[:-8] + bytes(4) + one[-4:], "none": b"plain", "bytes": gzip.compress(b"\xff")}
    (tmp_path / "c1").mkdir()
    for name, data in odd.items():
        (tmp_path / "c1" / f"{name}.gz").write_bytes(data)

    def found():
        return (sorted((r.file_name, r.content) for r in files.log_contents(spark, str(tmp_path)).collect()),
                sorted((r.file_path, r.reason) for r in files.rejected_files(spark, str(tmp_path)).collect()))

    in_rows = found()
    monkeypatch.setattr(files, "SMALL_MB", 0)
    assert in_rows == found() and {n for n, _ in in_rows[0]} >= {"members.gz", "nothing.gz"}


@pytest.mark.parametrize("gzipped", [False, True])
def test_written_files_share_folders(spark, tmp_path, gzipped):
    rows = [(f"c{i % 7}", f"c{i % 7}/r0/a:=%{i} ü.log", f"text {i}") for i in range(50)] + [
        (None, "c2/x", "lost"), ("c[3]", "c[3]/none", None), ("c1", "c1/r0/a:=%1 ü.log", "again")]
    contents = spark.createDataFrame(rows, "cluster_id STRING, file_path STRING, content STRING").coalesce(2)
    apart, shared = str(tmp_path / "apart"), str(tmp_path / "shared")

    def read(root, layout):
        return sorted(map(tuple, files.log_contents(spark, root, layout=layout).select("cluster_id", "file_name", "content").collect()))

    want = read(apart, files.write_contents(contents, apart, gzipped))
    assert read(shared, files.write_contents(contents, shared, gzipped, 10)) == want and len(want) >= 52
    folders = [f for f in (tmp_path / "shared").iterdir()]
    assert all(f.is_dir() and f.name.startswith("part-") and 1 <= len(list(f.iterdir())) <= 10 for f in folders) and len(folders) <= 8
