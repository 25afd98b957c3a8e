"""Jaccard self-join of texts on word shingles by chosen paths.

Words are maximal runs of non-space characters, in lower case. A text's set
holds its runs of five words (a shorter text has one run of all its words).
Texts with equal sets are one node with a number of copies, so copies never
meet each other as pairs.

A path is a chain of minimum hashes, and two sets share it with the probability
of their similarity to the power of its length. Nodes that share a path with at
most ``limit`` nodes are compared by brute force. Nodes of larger paths go on to
longer chains, in as many runs of hashes of their own as the target recall needs
at that length (see ``runs_of``); a path of the last length is compared whole in
blocks, whatever its size. A pair is lost only if it shares no path at a length
that both of its nodes come to, so the chances of that, summed over the lengths,
bound the loss at ``1 - recall`` for a pair at the threshold and less above it.

Every pair is compared in one place only, the smallest path that both nodes
end in, so links are counted once without a list of pairs. Paths are compared
in blocks of nodes; a task holds two blocks at most, whatever the size of a
group, and returns link counts and a spanning forest instead of pairs. Sets are
compared exactly, on 64-bit hashes of shingles.

Defined results: a null text or one without words has no links and a class of
its own (its id); repeated rows are copies of each other; null ids take part
but never name a class unless all ids of it are null; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import ship, written
from runscope.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999999    # least chance that a pair at the threshold is compared
ROOTS = 12           # least number of runs over chains of one hash
LIMIT = 2048         # nodes of a path beyond which its nodes go on to longer chains
DEPTH = 3            # longest chain; its paths are all compared, in blocks
BLOCK = 512          # nodes of a block
BLOCK_SHINGLES = 1_500_000
BROADCAST_ROWS = 400_000
DOCS_A_BATCH = 256
_POWER = np.uint64(0x9E3779B97F4A7C15)


def miss_probability(similarity: float = THRESHOLD, depth: int = 1, roots: int = ROOTS) -> float:
    """Chance that a pair of this similarity shares no path of ``depth`` in so many runs."""
    return (1 - similarity**depth) ** roots


def runs_of(level: int, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs over chains of ``level`` hashes: each length may lose an equal part of what the recall leaves."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold and recall lie between 0 and 1")
    own = 1 if threshold == 1 else math.ceil(math.log((1 - recall) / depth) / math.log1p(-threshold**level))
    return max(own, ROOTS if level == 1 else 1)


def sketch_size(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Minimum hashes a node keeps, so that no two runs of a length share one."""
    return max(level * runs_of(level, threshold, recall, depth) for level in range(1, depth + 1))


@lru_cache
def _multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(20250101).integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)


# ---- sets ----------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's shingles. Words of all texts are hashed together."""
    split = [t.lower().split() if t else [] for t in texts]
    flat = [w for own in split for w in own]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
    out, at = [], 0
    for own in split:
        mine = hashed[at:at + len(own)]
        at += len(own)
        width = min(words, len(mine))
        if not width:
            out.append(np.zeros(0, np.uint64))
            continue
        run = np.full(len(mine) - width + 1, width, np.uint64)
        for k in range(width):
            run = run * _POWER + mine[k:k + len(run)]
        out.append(np.unique(_mixed(run)))
    return out


def set_name(own: np.ndarray) -> bytes:
    """128 bits that name a set: its size and hashes, summed in two ways."""
    with np.errstate(over="ignore"):
        first = _mixed(own + np.uint64(len(own))).sum(dtype=np.uint64)
        second = _mixed(own * _POWER ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(first).to_bytes(8, "big") + int(second).to_bytes(8, "big")


def _sketch(own: np.ndarray, hashes: int) -> bytes:
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):     # products with odd numbers order shingles anew
        np.minimum(out, (own[at:at + 4096, None] * _multipliers(hashes)).min(axis=0), out=out)
    return _mixed(out).astype("<u4").tobytes()


def sets_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: int | None = None) -> DataFrame:
    """``doc_id, row_key, n, node, sketch`` for every row, slim and without texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()),
                        ("node", pa.binary()), ("sketch", pa.binary())])
    hashes = hashes or sketch_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(at, DOCS_A_BATCH)
                sets = shingle_sets(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_sketch(s, hashes) if len(s) else None for s in sets], pa.binary())], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text), F.col(text)).mapInArrow(
        run, "doc_id long, row_key long, n long, node binary, sketch binary")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by id and text; equal only for repeated rows."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("row_key")


# ---- paths ---------------------------------------------------------------------


def _path(level: int, run: int) -> Column:
    """The chain of ``level`` minimum hashes of a sketch (4 bytes each) that belongs to a run alone."""
    own = F.substring("sketch", 4 * level * run + 1, 4 * level)
    return F.xxhash64(F.lit(level), F.lit(run), own)


def paths_of(nodes: DataFrame, limit: int = LIMIT, depth: int = DEPTH, *, threshold: float = THRESHOLD,
             recall: float = RECALL) -> DataFrame:
    """``path, node, n, copies, members, shingles`` of all final paths with two nodes or more.

    The sketches of ``nodes`` hold ``sketch_size`` hashes for the same threshold, recall and depth.
    """
    now, final = nodes, None
    for level in range(1, depth + 1):
        walked = now.select("node", "n", "copies", F.explode(F.array(*[
            _path(level, run) for run in range(runs_of(level, threshold, recall, depth))])).alias("path"))
        sizes = walked.groupBy("path").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        shared = written(walked.join(sizes.filter("members > 1"), "path"), f"paths-{level}")
        small = shared if level == depth else shared.filter(F.col("members") <= limit)
        final = small if final is None else final.unionByName(small)
        large = shared.filter(F.col("members") > limit)
        if level == depth or large.isEmpty():
            break
        now = nodes.join(large.select("node").distinct(), "node")
    return final


def _blocks(paths: DataFrame) -> DataFrame:
    """Every node of a path in all pairs of blocks that hold it: ``unit`` names a pair."""
    count = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_blocks"))
    return (
        paths.withColumn("n_blocks", count.cast("long")).withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("unit", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("one_block", F.col("block") == F.col("other"))
        .drop("n_blocks", "other", "members", "shingles")
    )


# ---- comparisons ---------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal ``(unit, path)``, from rows sorted by these."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for row in batch.slice(at, 1024).to_pylist():
                if held and (row["unit"], row["path"]) != (held[0]["unit"], held[0]["path"]):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _open_pairs(rows: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs to compare here: sizes allow the threshold and no smaller path is common."""
    path = rows[0]["path"]
    n = np.array([r["n"] for r in rows], np.float64)
    block = np.array([r["block"] for r in rows])
    a, b = np.triu_indices(len(rows), 1)
    fits = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
    if not rows[0]["one_block"] or len(set(block.tolist())) > 1:
        fits &= block[a] != block[b]
    a, b = a[fits], b[fits]
    if not len(a):
        return a, b
    smaller = [[k for k in r["paths"] if k < path] for r in rows]
    names = {k: i for i, k in enumerate(sorted({k for own in smaller for k in own}))}
    if names:
        has = np.zeros((len(rows), len(names)), np.float32)
        for i, own in enumerate(smaller):
            has[i, [names[k] for k in own]] = 1
        first = (has @ has.T)[a, b] == 0
        a, b = a[first], b[first]
    return a, b


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = column[keep], owner[keep]
    if not len(column):
        return np.zeros(len(a), np.int64)
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 16_384
    for low in range(0, int(column[-1]) + 1, width):
        s, e = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[s:e], column[s:e] - low] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _compare(threshold: float):
    schema = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            rows = list({r["node"]: r for r in rows}.values())   # repeated rows bring a text twice
            sets = shingle_sets([r["text"] for r in rows])
            a, b = _open_pairs(rows, threshold)
            if not len(a):
                continue
            both = _intersections(sets, a, b)
            n = np.array([len(s) for s in sets], np.int64)
            near = both >= threshold * (n[a] + n[b] - both) - 1e-9
            a, b = a[near], b[near]
            if not len(a):
                continue
            copies = np.array([r["copies"] for r in rows], np.int64)
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = list(range(len(rows)))
            for i, j in zip(a.tolist(), b.tolist()):
                while root[i] != i:
                    i = root[i] = root[root[i]]
                while root[j] != j:
                    j = root[j] = root[root[j]]
                root[max(i, j)] = min(i, j)
            tops = []
            for i in range(len(rows)):
                k = i
                while root[k] != k:
                    k = root[k]
                tops.append(k)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i]["node"] for i in hit], pa.binary()),
                pa.array([rows[tops[i]]["node"] for i in hit], pa.binary()),
                pa.array(links[hit])], schema=schema)

    return run


def _needed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            a, b = _open_pairs(rows, threshold)
            if len(a):
                own = [rows[i] for i in np.union1d(a, b)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["unit"] for r in own], pa.int64()), pa.array([r["node"] for r in own], pa.binary())],
                    ["unit", "node"])

    return run


def fits_broadcast(keys: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return keys.limit(rows + 1).count() <= rows


def links_of(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``node, other, links``: counts to be summed by node, and edges of spanning forests.

    ``nodes`` has ``node, n, copies, sketch, row_key``. First slim rows decide
    which nodes have anything to compare in which pair of blocks; only their
    texts, one row for all copies, are moved.
    """
    paths = paths_of(nodes, threshold=threshold, recall=recall)
    every = paths.groupBy("node").agg(F.collect_list("path").alias("paths"))   # bounded by the runs of all lengths
    units = _blocks(paths.join(every, "node"))
    sort = lambda df: df.repartition("unit").sortWithinPartitions("unit", "path")
    slim = units.select("unit", "path", "block", "one_block", "node", "n", "copies", "paths")
    needed = written(
        sort(slim).mapInArrow(_needed(threshold), "unit long, node binary")
        .join(slim, ["unit", "node"]).join(nodes.select("node", "row_key"), "node"), "compare")
    keys = needed.select("row_key").distinct()
    texts = docs.select(row_key(doc_id, text), F.col(text).alias("text"))
    if fits_broadcast(keys):
        # all rows of a text's key are few longs, so texts nobody needs are dropped where they are read
        texts = texts.join(F.broadcast(keys), "row_key", "left_semi")
    pairs = needed.join(texts, "row_key").drop("row_key")
    return sort(pairs).mapInArrow(_compare(threshold), "node binary, other binary, links long")


def nodes_of(sets: DataFrame) -> DataFrame:
    """Rows with equal sets as one node: ``node, first_doc, copies, n, sketch, row_key``."""
    return sets.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.min("n").alias("n"),
        F.min("sketch").alias("sketch"), F.min("row_key").alias("row_key"))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, row_key, class_id, n_links, keeper`` for every row.

    ``class_id`` is the smallest document id that links lead to, ``n_links``
    the number of other rows with a similarity of ``threshold`` or more, copies
    included. ``keeper`` marks the row that stands for its class (all of its
    repeated rows, if the table has any).
    """
    sets = written(sets_of(docs, doc_id, text, sketch_size(threshold, recall)), "sets")
    nodes = written(nodes_of(sets), "nodes")
    links = written(links_of(docs, nodes, doc_id, text, threshold, recall), "links")
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("node", "first_doc", "copies", "row_key").join(groups, "node", "left").join(counts, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    # ids of classes, and the row that stands for each: smallest id, then smallest key
    classes = placed.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    linked = placed.join(classes, "label").select(
        "node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "label")
    rows = sets.select("doc_id", "row_key", "n", "node").join(linked, "node", "left")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    best = rows.filter("n > 0").groupBy("label").agg(F.min(order).alias("best")).select(
        "label", F.col("best.row_key").alias("best_key"))
    return rows.join(best, "label", "left").select(
        "doc_id", "row_key", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ((F.col("n") == 0) | (F.col("row_key") == F.col("best_key"))).alias("keeper"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class stays; rows without words all stay.

    The keys of dropped rows are broadcast if few, else both sides are
    shuffled. Only where a kept row is repeated do its repetitions meet.
    """
    classes = written(jaccard_classes(docs, doc_id, text, threshold, recall).select("row_key", "keeper"), "classes")
    dropped = classes.filter("not keeper").select("row_key").distinct()
    keyed = docs.withColumn("__key", row_key(doc_id, text))
    gone = dropped.withColumnRenamed("row_key", "__key")
    kept = keyed.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "__key", "left_anti")
    words = F.length(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))) > 0
    twice = classes.filter("keeper").groupBy("row_key").count().filter("count > 1").select(
        F.col("row_key").alias("__key"))
    if not twice.isEmpty():
        twice = written(twice, "repeated")
        few = F.broadcast(twice) if fits_broadcast(twice) else twice
        again = kept.join(few, "__key", "left_semi")
        kept = kept.join(few, "__key", "left_anti").unionByName(
            again.filter(~words)).unionByName(again.filter(words).dropDuplicates(["__key"]))
    return kept.drop("__key")
