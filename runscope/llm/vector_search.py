"""Nearest neighbours by cosine: a block matrix join with exact results.

Vectors are packed into blocks. A tile, one block of queries times one block of
rows, is first multiplied in int8, which bounds every cosine from both sides;
pairs whose upper bound reaches the k-th lower bound are computed again from
the original vectors in double precision. Tasks keep a heap per query, and the
heaps of all tasks are merged at the end.

Blocks of queries are broadcast if their measured bytes are below a bound. Else
blocks of rows and blocks of queries meet in a grid of tiles.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components take no part, nor do rows with a null id; only vectors of
equal length are compared; a candidate is every row whose id is not the
query's, so repeated rows are candidates each; a query id with several vectors
uses the smallest; ties go to the smaller id; empty tables give an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import ship, written

ROWS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024
QUERIES_A_TILE = 256
BROADCAST_BYTES = 32 << 20
HEAPS = 100_000        # queries a task holds heaps for at once
GUARD = 1e-7           # added to the bounds for rounding


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last as plain SQL does."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += a * b
    return total


def unit_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one and lengths, safe against overflow of squares."""
    with np.errstate(over="ignore"):
        norm = np.sqrt(dot(x, x))
    if not (np.isfinite(norm) & (norm > 1e-140)).all():
        top = np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(dot(x / top, x / top)) * top[:, 0]
    return x / norm[:, None], norm


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, length of the coded vector and of what the code misses."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    coded = codes * scale[:, None]
    return (codes.astype(np.int8), scale, np.sqrt((coded * coded).sum(axis=1)),
            np.sqrt(((unit - coded) ** 2).sum(axis=1)))


def _packed(df: DataFrame, rows: int, kind: str) -> DataFrame:
    """Blocks ``dim, n, ids, data`` of vectors of equal length."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                schema=schema)

        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(np.diff(vectors.offsets.to_numpy()))
            begin = 0
            for name, end in zip(batch.column(0).to_pylist(), ends):
                ids, data = held.setdefault(int(end - begin), ([], []))
                ids.append(name)
                data.append(flat[begin:end].tobytes())
                if len(ids) == rows:
                    yield block(int(end - begin))
                begin = end
        for dim in list(held):
            yield block(dim)

    return df.mapInArrow(run, "dim int, n int, ids binary, data binary")


def tile(q_ids, q, r_ids, r, k: int, floor: np.ndarray):
    """Exact ``(query index, row id, cosine)`` of all pairs that can be among the ``k`` best.

    ``floor`` has a cosine per query that a pair must reach.
    """
    q_unit, q_norm = unit_vectors(q)
    r_unit, r_norm = unit_vectors(r)
    qc, qs, qa, qe = quantised(q_unit)
    rc, rs, ra, re = quantised(r_unit)
    rows_f = rc.astype(np.float32).T
    for at in range(0, len(q), QUERIES_A_TILE):
        own = slice(at, at + QUERIES_A_TILE)
        dots = np.zeros((len(qc[own]), len(r)), np.float64)
        for c in range(0, q.shape[1], 1024):       # products of int8 are exact in float32 up to here
            dots += qc[own, c:c + 1024].astype(np.float32) @ rows_f[c:c + 1024]
        middle = dots * qs[own, None] * rs[None, :]
        error = qa[own, None] * re + qe[own, None] * ra + qe[own, None] * re + GUARD
        same = q_ids[own, None] == r_ids[None, :]
        low = np.where(same, -np.inf, middle - error)
        best = floor[own]
        if len(r) > k:
            best = np.maximum(best, np.partition(low, len(r) - k, axis=1)[:, len(r) - k])
        i, j = np.nonzero(~same & (middle + error >= best[:, None]))
        for s in range(0, len(i), 65_536):
            a, b = i[s:s + 65_536] + at, j[s:s + 65_536]
            with np.errstate(over="ignore", invalid="ignore"):
                cosine = dot(q[a], r[b]) / (q_norm[a] * r_norm[b])
            odd = ~np.isfinite(cosine)
            if odd.any():
                cosine[odd] = dot(q_unit[a[odd]], r_unit[b[odd]])
            yield a, r_ids[b], cosine


def _search(k: int, kind: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(q, -m, s) for q, heap in heaps.items() for s, m in heap]
            heaps.clear()
            columns = list(zip(*rows)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_data, r_ids, r_data = (batch.column(c)[row].as_py() for c in range(5))
                q_ids, r_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(r_ids, "<i8")
                q = np.frombuffer(q_data, kind).reshape(-1, dim).astype(np.float64)
                r = np.frombuffer(r_data, kind).reshape(-1, dim).astype(np.float64)
                floor = np.array([heaps[i][0][0] if len(heaps.get(i, ())) == k else -np.inf for i in q_ids.tolist()])
                for a, found, cosine in tile(q_ids, q, r_ids, r, k, floor):
                    for i, name, score in zip(q_ids[a].tolist(), found.tolist(), cosine.tolist()):
                        heap = heaps.setdefault(i, [])
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -name))
                        elif (score, -name) > heap[0]:
                            heapq.heapreplace(heap, (score, -name))
                if len(heaps) > HEAPS:
                    yield out()
        yield out()

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
            broadcast_bytes: int = BROADCAST_BYTES, groups: int = 64) -> DataFrame:
    """The ``k`` nearest rows of every query: ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    ship(spark)
    double = any("double" in df.schema[embedding].dataType.simpleString() for df in (rows, queries))
    kind = "<f8" if double else "<f4"
    array = "array<double>" if double else "array<float>"
    asked = (
        usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .select("vec_id", F.col("embedding").cast(array))
    )
    blocks = written(_packed(asked, QUERIES_A_BLOCK, kind), "query-blocks").select(
        "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    size = blocks.agg(F.coalesce(F.sum(F.length("q_data") + F.length("q_ids")), F.lit(0))).first()[0]
    packed = _packed(usable(rows, vec_id, embedding).select("vec_id", F.col("embedding").cast(array)), ROWS_A_BLOCK, kind)
    if size <= broadcast_bytes:
        tiles = packed.join(F.broadcast(blocks), "dim")
    else:
        # a grid: rows go to every slice of the query blocks, queries to every group of row blocks
        slices = -(-size // broadcast_bytes)
        packed = packed.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn(
            "s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        blocks = blocks.withColumn("s", F.pmod(F.xxhash64("q_ids"), F.lit(slices))).withColumn(
            "g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        tiles = packed.join(blocks, ["dim", "s", "g"])
    found = tiles.select("dim", "q_ids", "q_data", "ids", "data").mapInArrow(
        _search(k, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
