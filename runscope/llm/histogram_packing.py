"""Shortest-pack-first packing over the histogram of document lengths.

A document of more than ``limit`` tokens gives full sequences and a rest; rests
and shorter documents are placed by length, longest first. Documents of equal
length are one row of the histogram and sequences of equal content one packing
pattern with a count. The next length goes into the shortest pack if it fits
there, which lowers the count of that pattern and raises that of the longer one,
else it opens a new pack.

Packs that remain open then lose their padding. As few of the shortest as have
the tokens that the others lack are taken apart: their documents, laid end to
end, are cut where one gap ends and the next begins. What is left behind the
last gap is less than a sequence and is cut into powers of two, which are not
padded. Packs that are filled up to a power of two stay as they are.

All this works on counts: a plan has some rows per pattern at any size of the
corpus. A document finds its place by its length and its rank among the
documents of that length, so hot lengths never meet in one task.

Defined results: a null or empty text is the end token alone; repeated rows and
null ids are packed like others; an empty table gives an empty table. Only the
two named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import broadcast_if_few, ship, written
from runscope.llm.tokens import encoder, vocabulary_size

LIMIT = 2048
END_ID = 1
DOCS_A_BATCH = 512
RANKS_BROADCAST = 4_000_000     # rows (length, part, first): 16 bytes each

Pattern = tuple[tuple[int, int], ...]      # (length, how many) in order of their place


# ---- shortest pack first --------------------------------------------------------


def shortest_pack_first(counts: dict[int, int], limit: int) -> dict[int, dict[Pattern, int]]:
    """Packs by filled tokens: ``tokens -> {pattern: packs}``, a pattern being ``(length, how many)`` pairs."""
    packs: dict[int, dict[Pattern, int]] = {}
    open_: list[int] = []          # filled tokens of open packs, a heap

    def put(filled: int, pattern: Pattern, n: int) -> None:
        if filled not in packs:
            packs[filled] = {}
            if filled < limit:
                heapq.heappush(open_, filled)
        packs[filled][pattern] = packs[filled].get(pattern, 0) + n

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            if not open_ or open_[0] + size > limit:
                # a new pack is the shortest until nothing of this size fits any more
                each = min(limit // size, left)
                put(each * size, ((size, each),), left // each)
                left %= each
                continue
            filled = open_[0]
            pattern, n = next(iter(packs[filled].items()))
            # as often as the pack stays the shortest, so that many short documents take few steps
            beyond = min(open_[1:3], default=limit)
            each = max(1, min((beyond - filled) // size, (limit - filled) // size))
            each = min(each, max(1, left // n))
            used = min(n, left // each)
            if used == n:
                del packs[filled][pattern]
                if not packs[filled]:
                    heapq.heappop(open_)
                    del packs[filled]
            else:
                packs[filled][pattern] = n - used
            put(filled + each * size, (*pattern, (size, each)), used)
            left -= used * each
    return packs


# ---- no padding -----------------------------------------------------------------


@dataclass
class Plan:
    """Where documents of a length go, by their rank among them.

    ``whole[length]`` has rows ``(first rank, how many a sequence, first
    sequence, offset)``. Ranks from ``cut[length][0]`` on are laid end to end
    from position ``cut[length][1]``; ``gaps`` has rows ``(first position,
    tokens, first sequence, offset)`` of runs of equal gaps along these positions.
    """

    whole: dict[int, np.ndarray]
    cut: dict[int, tuple[int, int]]
    gaps: np.ndarray
    sequences: int


def _split_open(packs: dict[int, dict[Pattern, int]], limit: int) -> tuple[list, list, list]:
    """Runs ``(filled, pattern, packs)``: without padding, to be filled, to be taken apart.

    Taking one pack apart brings its tokens and spares its gap, ``limit`` in all.
    """
    runs = sorted((f, p, n) for f, own in packs.items() for p, n in own.items())
    done = [r for r in runs if r[0] == limit or r[0] & (r[0] - 1) == 0]
    open_ = [r for r in runs if not (r[0] == limit or r[0] & (r[0] - 1) == 0)]
    give = -(-sum((limit - f) * n for f, _, n in open_) // limit)
    keep, apart = [], []
    for filled, pattern, n in open_:
        k = min(n, give)
        give -= k
        if k:
            apart.append((filled, pattern, k))
        if n > k:
            keep.append((filled, pattern, n - k))
    return done, keep, apart


def plan(counts: dict[int, int], limit: int = LIMIT) -> Plan:
    """A plan without padding for a histogram of lengths up to ``limit``."""
    done, keep, apart = _split_open(shortest_pack_first(counts, limit), limit)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence, position, gaps = 0, 0, []
    for k, (filled, pattern, n) in enumerate(done + keep):
        offset = 0
        for size, each in pattern:
            rows.setdefault(size, []).append((rank.get(size, 0), each, sequence, offset))
            rank[size] = rank.get(size, 0) + each * n
            offset += each * size
        if k >= len(done):
            gaps.append((position, limit - filled, sequence, filled))
            position += (limit - filled) * n
        sequence += n
    laid: dict[int, int] = {}
    for _, pattern, n in apart:
        for size, each in pattern:
            laid[size] = laid.get(size, 0) + each * n
    cut, end = {}, 0
    for size in sorted(laid, reverse=True):
        cut[size] = (rank.get(size, 0), end)
        end += size * laid[size]
    while position < end:                               # less than a sequence
        tokens = 1 << ((end - position).bit_length() - 1)
        gaps.append((position, tokens, sequence, 0))
        position, sequence = position + tokens, sequence + 1
    return Plan({size: np.array(r, np.int64) for size, r in rows.items()}, cut,
                np.array(gaps, np.int64).reshape(-1, 4), sequence)


def places(made: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """``(start, tokens, sequence, offset)`` of the parts of the document of that length and rank."""
    first, position = made.cut.get(length, (None, 0))
    if first is None or rank < first:
        rows = made.whole[length]
        at = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1].tolist()
        k = rank - at[0]
        return [(0, length, at[2] + k // at[1], at[3] + k % at[1] * length)]
    out, start = [], 0
    position += (rank - first) * length
    while start < length:
        base, tokens, sequence, offset = made.gaps[
            np.searchsorted(made.gaps[:, 0], position, side="right") - 1].tolist()
        k, inside = divmod(position - base, tokens)
        take = min(tokens - inside, length - start)
        out.append((start, take, sequence + k, offset + inside))
        start, position = start + take, position + take
    return out


# ---- documents ------------------------------------------------------------------


def items(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Full sequences and rests: ``doc_id, start, length, doc_tokens, ids, part, nth``.

    ``ids`` take 16 bits each where the vocabulary allows, else 32. ``nth``
    numbers the items of equal length inside a task, ``part`` is that task.
    """
    kind = id_kind(tokenizer, end_id)
    width = int(kind[-1])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(at, DOCS_A_BATCH)
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(encode(body) + end, "<u4").astype(kind).tobytes()
                    total = len(ids) // width
                    for start in range(0, total, limit):
                        length = min(limit, total - start)
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, start, length, total, ids[width * start:width * (start + length)], part, nth))
                columns = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        run, "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth long")


def id_kind(tokenizer: str, end_id: int = END_ID) -> str:
    return "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"


def pack(cut: DataFrame, kind: str, limit: int = LIMIT) -> DataFrame:
    """Pieces with their place: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    ``cut`` is a written table of :func:`items`, read twice. The rank of an item
    is its number inside its task plus the items of its length in earlier tasks;
    these first ranks are broadcast if they are few, else they are joined with
    the items. ``ids`` are little-endian unsigned 32-bit integers.
    """
    tasks = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(tasks.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")),
                     "first-ranks")
    counts = {r[0]: r[1] for r in firsts.groupBy("length").agg(F.sum("n")).collect()}     # at most `limit` rows
    made = plan(counts, limit)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                rows = []
                for doc, begin, length, total, ids, rank in zip(*(c.to_pylist() for c in big.slice(at, DOCS_A_BATCH).columns)):
                    whole = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                    for start, tokens, sequence, offset in places(made, length, rank):
                        rows.append((doc, begin + start, tokens, total, bytes(whole[4 * start:4 * (start + tokens)]),
                                     sequence, offset))
                columns = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ranked = cut.join(broadcast_if_few(firsts.drop("n"), RANKS_BROADCAST), ["length", "part"])
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("nth")).alias("rank")
                         ).mapInArrow(place, "doc_id long, start long, length long, doc_tokens long, ids binary, "
                                             "sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """All documents as placed pieces; writes the items to the shared folder and plans while it is called."""
    return pack(written(items(docs, tokenizer, limit, end_id), "packing-items"), id_kind(tokenizer, end_id), limit)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids``; a group has at most ``limit`` ids."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own"),
    ).select("sequence_id", "n_tokens", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))
