"""Token files: frequency-ranked ids in byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus, so frequent tokens take one byte.
A rank takes one to four bytes; its length minus one sits in two bits of a
control byte, four ranks to a control byte. A block holds whole documents:

    magic ``RTK1`` | n_docs u32 | bytes of control u32 | bytes of data u32
    | doc ids i64[n_docs] | null flags u8[n_docs] | tokens u32[n_docs] | control | data

Control bytes of a document start at a byte border. Blocks are rows of Parquet
files, written through the engine's commit protocol, in ascending order of
document id (``part``, then ``seq``); the ranked ids are a second small table.
Decoding looks lengths up in a table of 256 control bytes and gathers the data
bytes of a whole block at once.

Defined results: a null or empty text is the end token alone; null ids come
first; rows of equal id follow each other by the checksum of their ids; an
empty table gives files without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runscope.llm.common import scratch, ship, written
from runscope.llm.tokens import batch_encoder, vocabulary_size

END_ID = 0
BLOCK_TOKENS = 1 << 19
PART_TOKENS = 8_000_000     # tokens a task sorts and writes
TEXT_BYTES = 1 << 23        # texts encoded at once
MAGIC = b"RTK1"
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


# ---- the code ------------------------------------------------------------------


def decode_ranks(control: np.ndarray, data: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Ranks of all documents of a block; ``tokens`` has the count of each."""
    lengths = LENGTHS[control].reshape(-1)
    slots = -(-tokens // 4) * 4
    if (slots != tokens).any():                 # unused codes behind a document's last rank
        ends = np.cumsum(slots)
        first_unused = ends - (slots - tokens)
        marks = np.zeros(len(lengths) + 1, np.int8)
        np.add.at(marks, first_unused, 1)
        np.add.at(marks, ends, -1)
        used = np.cumsum(marks[:-1]) == 0
        lengths = lengths[used]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_documents(ranks: np.ndarray, tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of many documents at once; ``tokens`` has the count of each."""
    ranks = ranks.astype(np.uint32)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = -(-tokens // 4) * 4
    codes = np.zeros(int(slots.sum()), np.uint8)
    # a document's codes start at a byte border, so all of its places move by what earlier ones leave free
    moved = np.repeat(np.cumsum(slots - tokens) - (slots - tokens), tokens)
    codes[np.arange(len(ranks)) + moved] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    whole = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), whole[np.arange(4) < lengths[:, None]].tobytes()


def pack_block(docs: list[int | None], ranks: list[np.ndarray]) -> bytes:
    tokens = np.array([len(r) for r in ranks], np.int64)
    return _block(docs, np.concatenate([np.zeros(0, np.uint32), *ranks]), tokens)


def _block(docs: list[int | None], ranks: np.ndarray, tokens: np.ndarray) -> bytes:
    """A block of documents whose ranks follow each other in ``ranks``."""
    control, data = encode_documents(ranks, tokens)
    return b"".join((
        MAGIC, struct.pack("<III", len(docs), len(control), len(data)),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        tokens.astype("<u4").tobytes(), control, data))


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and the ranks of all."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n, n_control, n_data = struct.unpack_from("<III", block, 4)
    if len(block) != 16 + 13 * n + n_control + n_data:
        raise ValueError("token block is cut or too long")
    docs = np.frombuffer(block, "<i8", n, 16)
    nulls = np.frombuffer(block, np.uint8, n, 16 + 8 * n)
    tokens = np.frombuffer(block, "<u4", n, 16 + 9 * n).astype(np.int64)
    control = np.frombuffer(block, np.uint8, n_control, 16 + 13 * n)
    data = np.frombuffer(block, np.uint8, n_data, 16 + 13 * n + n_control)
    ids = [None if z else int(d) for d, z in zip(docs, nulls)]
    return ids, tokens, decode_ranks(control, data, tokens)


# ---- writing -------------------------------------------------------------------


def id_kind(tokenizer: str, end_id: int = END_ID) -> str:
    return "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` whose texts, its second column, have up to ``TEXT_BYTES`` together; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, counts``; ids in 16 bits where the vocabulary allows, else 32.

    The last row of every task has ``counts`` instead of ids: how often the task
    saw each id, as int64 from id 0 on.
    """
    kind = id_kind(tokenizer, end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer)
        total = np.zeros(end_id + 1, np.int64)
        for big in batches:
            for batch in slices(big):
                ids, tokens = encode(batch.column(1))
                all_ids = np.insert(ids, np.cumsum(tokens), end_id)
                seen = np.bincount(all_ids, minlength=len(total))
                seen[:len(total)] += total
                total = seen
                narrow = memoryview(all_ids.astype(kind).tobytes())
                ends = np.cumsum(tokens + 1) * int(kind[-1])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).cast(pa.int64()),
                    pa.array([bytes(narrow[a:b]) for a, b in zip([0, *ends[:-1]], ends)], pa.binary()),
                    pa.nulls(len(tokens), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(([None], [None], [total.astype("<i8").tobytes()]), schema.types)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, ids binary, counts binary")


def token_counts(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the counts that every task left in its last row."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                n = np.frombuffer(counts.as_py(), "<i8")
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["id", "n"])

    return tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(
        spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes ``path/blocks`` and ``path/ranks``.

    Texts are tokenized once, into a table in the shared folder. The list of
    ranks has at most as many rows as the vocabulary and is all that visits the
    driver.
    """
    spark = docs.sparkSession
    kind = id_kind(tokenizer, end_id)
    tokens = written(token_ids(docs, tokenizer, end_id), "token-ids")
    counted = token_counts(tokens).collect()
    counted.sort(key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(r["id"], k, r["n"]) for k, r in enumerate(counted)],
                          "id long, rank long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.uint32)
    for k, r in enumerate(counted):
        rank_of[r["id"]] = k
    total = sum(r["n"] for r in counted)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_TOKENS))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("first", pa.int64()), ("block", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            tokens = np.array([len(x) for x in held], np.int64) // int(kind[-1])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (part, seq, len(names), len(ids), first, _block(names, rank_of[ids], tokens)), schema.types)],
                schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc)
                held.append(ids)
                size += len(ids) // int(kind[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    seq, first = seq + 1, first + size
                    names, held, size = [], [], 0
        if names:
            yield flush()

    (
        tokens.filter("ids IS NOT NULL").select("doc_id", "ids", F.crc32("ids").alias("__crc"))
        .repartitionByRange(parts, "doc_id", "__crc").sortWithinPartitions("doc_id", "__crc", "ids")
        .select("doc_id", "ids")
        .mapInArrow(blocks, "part int, seq int, n_docs long, n_tokens long, first long, block binary")
        .write.option("compression", "zstd").parquet(f"{path}/blocks")
    )


# ---- reading -------------------------------------------------------------------


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from files alone.

    ``start`` is the sum over earlier documents: sums of parts, of blocks inside
    a part (stored) and inside the block. Only one row per part is ever summed
    in one task.
    """
    ranked = spark.read.parquet(f"{path}/ranks").select("id", "rank").collect()  # vocabulary
    id_of = np.zeros(len(ranked) + 1, "<u4")
    for r in ranked:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.schema(
        "part int, seq int, n_docs long, n_tokens long, first long, block binary").parquet(f"{path}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    )
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, tokens, ranks = unpack_block(block.as_py())
                ids = id_of[ranks]
                ends = np.cumsum(tokens)
                begins = ends - tokens
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(start + begins), pa.array(tokens),
                    pa.array([bytes(raw[4 * a:4 * b]) for a, b in zip(begins, ends)], pa.binary()),
                ], schema=schema)

    ship(spark)
    return (
        blocks.join(F.broadcast(starts), "part")    # one row per written part
        .select((F.col("part_start") + F.col("first")).alias("start"), "block")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
    )


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path)
