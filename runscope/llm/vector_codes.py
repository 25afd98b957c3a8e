"""Product codes of vectors by exact integer k-means with a limb-split GEMM.

Every component becomes the integer ``floor(scale * x)``; vectors are cut into
equal parts with a codebook each. Squared distances come from dot products that
BLAS computes in float64: integers are broken into limbs so small that no sum of
products reaches 2^53, the products of limbs are exact, and they are put
together again in int64. The nearest entry is the first smallest distance.

A round is one job: tasks assign their vectors and send one sum and one count
per entry they use; the sums are added up as decimals, and the codebooks, whose
size is a parameter, visit the driver.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped; a null id comes after all others when the first
codebook is chosen and is coded like others; rows of equal id follow each other
by their components; repeated rows count each; fewer rows than entries give
smaller codebooks; an empty table gives an empty table. Vectors must have one
length that the parts divide, and components must be small enough for distances
in 64 bits; anything else is an error. Only the three named columns are read,
so other columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import broadcast_if_few, ship, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
ROWS_A_BATCH = 4096
EXACT = 53              # bits of integers that float64 holds
LABELS_BROADCAST = 200_000


# ---- exact products ------------------------------------------------------------


def limb_bits(length: int) -> int:
    """Bits of a limb: ``length`` products of two limbs add up to less than 2^53."""
    return (EXACT - max(length - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs, lowest first: ``x = sum(limb[i] << bits * i)``.

    All limbs but the last lie in ``[0, 2^bits)``, the last has the sign.
    """
    out = []
    while len(x) and max(int(x.max(initial=0)), -int(x.min(initial=0))) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact as long as the results fit into int64."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def largest_component(length: int) -> int:
    """Bound of components for which distances over ``length`` components stay below 2^63."""
    return int((2 ** 63 // (4 * max(length, 1))) ** 0.5) - 1


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equal ones) and its squared distance."""
    rest = (entries * entries).sum(axis=1)[None, :] - 2 * exact_products(x, entries)
    code = rest.argmin(axis=1)
    return code, rest[np.arange(len(x)), code] + (x * x).sum(axis=1)


# ---- vectors -------------------------------------------------------------------


def whole_components(rows: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding",
                     label: str = "label") -> DataFrame:
    """``vec_id, label, dim, data`` of usable vectors; ``data`` is little-endian int64."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{embedding}`").cast("array<double>").alias("embedding"),
    ).filter((F.size("embedding") > 0) & F.forall("embedding", finite))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(vectors.offsets.to_numpy())
            if np.abs(flat).max(initial=0) * scale > largest_component(int(sizes.max(initial=1))):
                raise ValueError(f"a component times {scale} has no exact distance in 64 bits")
            whole = memoryview(np.floor(flat * scale).astype("<i8").tobytes())
            ends = np.cumsum(sizes) * 8
            data = [bytes(whole[a:b]) for a, b in zip(ends - sizes * 8, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
                ["vec_id", "label", "dim", "data"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id long, label {kind}, dim int, data binary")


def _matrices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), ROWS_A_BATCH):
        own = column.slice(at, ROWS_A_BATCH)
        yield np.frombuffer(b"".join(own.to_pylist()), "<i8").reshape(-1, dim)


def first_codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Parts of the vectors with the smallest ids; ``entries`` rows visit the driver."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "data").limit(entries).select("data").collect()
    whole = np.frombuffer(b"".join(bytes(r["data"]) for r in rows), "<i8").reshape(-1, dim)
    return [part.copy() for part in np.split(whole, parts, axis=1)]


def entry_sums(vectors: DataFrame, codebooks: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """``(part, entry) -> (count, componentwise sum)`` over all vectors, entries in use only."""
    parts, width = len(codebooks), codebooks[0].shape[1]
    names = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in codebooks]
        sums = [np.zeros((len(book), width), np.int64) for book in codebooks]
        for batch in batches:
            for x in _matrices(batch.column(0), parts * width):
                for k, book in enumerate(codebooks):
                    own = np.ascontiguousarray(x[:, k * width:(k + 1) * width])
                    code, _ = nearest_entries(own, book)
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                    used = code[order][starts]
                    counts[k][used] += np.diff(starts, append=len(code))
                    sums[k][used] += np.add.reduceat(own[order], starts, axis=0)
        for k in range(parts):
            used = np.flatnonzero(counts[k])
            if len(used):
                columns = [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[k][used])]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(np.ascontiguousarray(sums[k][used, c])) for c in range(width)],
                    ["part", "entry", "n", *names])

    schema = "part int, entry int, n long, " + ", ".join(f"{n} long" for n in names)
    total = vectors.select("data").mapInArrow(run, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names])
    return {(r["part"], r["entry"]): (r["n"], [int(r[n]) for n in names]) for r in total.collect()}


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds of k-means in integers."""
    codebooks = first_codebooks(vectors, dim, parts, entries)
    for _ in range(rounds):
        for (part, entry), (n, sums) in entry_sums(vectors, codebooks).items():
            codebooks[part][entry] = [s // n for s in sums]
    return codebooks


def assign(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    dim = sum(book.shape[1] for book in codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for x in _matrices(batch.column(2), dim):
                error, code, at = np.zeros(len(x), np.int64), [], 0
                for book in codebooks:
                    best, distance = nearest_entries(np.ascontiguousarray(x[:, at:at + book.shape[1]]), book)
                    at += book.shape[1]
                    error += distance
                    code.append(best.astype(np.uint8))
                whole = np.stack(code, axis=1).tobytes().hex()
                step = 2 * len(codebooks)
                codes += [whole[i:i + step] for i in range(0, len(whole), step)]
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()),
                 pa.array(np.concatenate(errors) if errors else [], pa.int64())], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "data").mapInArrow(
        run, f"vec_id long, label {kind}, code string, error long")


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    text = ",".join(str(v) for book in codebooks for v in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
               vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Runs ``rounds`` jobs while it is called, on a table of whole components
    that it writes to the shared folder. A code has one byte an entry index.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit into one byte")
    ship(rows.sparkSession)
    vectors = written(whole_components(rows, scale, vec_id, embedding, label), "whole-components")
    low, high = vectors.agg(F.min("dim"), F.max("dim")).first()
    if low != high or (low or 0) % parts:
        raise ValueError(f"vectors have {low} to {high} components; {parts} equal parts need one length they divide")
    if low is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codebooks = train(vectors, low, parts, entries, rounds)
    coded = written(assign(vectors, codebooks), "vector-codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "__label")
    return coded.join(broadcast_if_few(sums, LABELS_BROADCAST), coded["label"].eqNullSafe(sums["__label"])).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
