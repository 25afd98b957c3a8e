"""Best-fit packing of tokenized documents into sequences by bin completion.

Documents become pieces of at most ``limit`` tokens. Where a piece goes depends
on its length alone, so the search works on the histogram of lengths, which has
at most ``limit`` rows at any size of the corpus. Its result, a list of fillings
with the number of sequences that use each, is mapped back to pieces by their
rank among pieces of equal length. Pieces themselves stay on the executors.

Search: best-fit decreasing gives the incumbent. Bin completion then enumerates
undominated fillings around the largest piece left, least waste first, and
gives up a branch once its waste exceeds what a solution with one sequence less
may waste. A filling is used for as many sequences as the counts allow, which
keeps the depth below the number of lengths. The search ends when the count
meets the lower bound, or after ``nodes`` steps with the best solution so far.

Defined results: a null or empty text is the end token alone; repeated rows and
null ids are packed like others; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import ship, written
from runscope.llm.tokens import encoder

LIMIT = 4096
END_ID = 1
NODES = 2000          # steps of the search
FILLINGS = 24         # fillings tried at a step
TRIES = 3000          # partial fillings looked at in one enumeration
DOCS_A_BATCH = 512
Filling = tuple[tuple[int, int], ...]     # (length, how many), longest first


# ---- pieces -------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, part, nth``.

    ``ids`` are little-endian unsigned 32-bit integers. ``nth`` numbers the
    pieces of equal length inside a task, ``part`` is that task.
    """
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()),
                        ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(at, DOCS_A_BATCH)
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encode(body) + end
                    for k, start in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[start:start + 4 * limit]
                        length = len(own) // 4
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, k, start // 4, length, own, part, nth))
                columns = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


# ---- search on the histogram ---------------------------------------------------


def lower_bound(counts: dict[int, int], limit: int) -> int:
    total = sum(s * n for s, n in counts.items())
    return max(-(-total // limit), sum(n for s, n in counts.items() if 2 * s > limit))


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing; bins with equal contents are one entry."""
    rooms: dict[int, dict[Filling, int]] = {}
    order: list[int] = []                       # rooms in use, ascending

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            order.insert(bisect_right(order, room), room)
        rooms[room][filling] = rooms[room].get(filling, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(order, size - 1)
            if at == len(order):                # new bins, filled with this size at once
                each = min(limit // size, left)
                bins = left // each
                put(limit - each * size, ((size, each),), bins)
                left -= bins * each
                continue
            room = order[at]
            filling, bins = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // size, left)
            used = min(bins, left // each)
            if used < bins:
                put(room, filling, bins - used)
            put(room - each * size, (*filling, (size, each)), used)
            left -= used * each
    return [(f, n) for room in sorted(rooms) for f, n in rooms[room].items()]


def _dominated(filling: Filling, slack: int, sizes: list[int], left: dict[int, int]) -> bool:
    """True if one unused longer piece fits in place of one or two pieces of the filling."""
    if not slack:
        return False
    own = [s for s, n in filling for _ in range(min(n, 2))]
    sums = set(own) | {a + b for i, a in enumerate(own) for b in own[i + 1:]}
    used = dict(filling)
    for s in sums:                              # sizes ascend
        for x in sizes[bisect_right(sizes, s):bisect_right(sizes, s + slack)]:
            if left[x] > used.get(x, 0):
                return True
    return False


def fillings(gap: int, left: dict[int, int], sizes: list[int], waste: int) -> list[tuple[int, Filling]]:
    """Undominated fillings of ``gap`` that waste at most ``waste``: ``(wasted, filling)``, best first."""
    found: dict[Filling, int] = {}
    tries = 0
    stack: list[tuple[int, int, Filling]] = [(gap, bisect_right(sizes, gap), ())]
    while stack and tries < TRIES and len(found) < FILLINGS:
        room, top, filling = stack.pop()
        tries += 1
        top = min(top, bisect_right(sizes, room))
        if top == 0:
            if room <= waste and not _dominated(filling, room, sizes, left):
                found[filling] = room
            continue
        size = sizes[top - 1]
        most = min(left[size], room // size)
        # popped last: as many as fit of the largest size; less of it waits below
        for n in range(0, most + 1) if most <= 4 else (0, 1, most - 1, most):
            more = (*filling, (size, n)) if n else filling
            stack.append((room - n * size, top - 1, more))
    return sorted((w, f) for f, w in found.items())


def complete(counts: dict[int, int], limit: int, most: int, nodes: int) -> list[tuple[Filling, int]] | None:
    """A packing into at most ``most`` bins by bin completion, or None if none was found."""
    total = sum(s * n for s, n in counts.items())
    allowed = most * limit - total
    if allowed < 0:
        return None
    left = dict(counts)
    path: list[list] = []       # [choices still open, chosen filling, bins, wasted before]
    wasted = 0
    for _ in range(nodes):
        sizes = sorted(s for s, n in left.items() if n)
        if not sizes:
            return [(step[1], step[2]) for step in path]
        top = sizes[-1]
        left[top] -= 1
        open_ = [(w, ((top, 1), *f) if not f or f[0][0] != top else ((top, f[0][1] + 1), *f[1:]))
                 for w, f in fillings(limit - top, left, [s for s in sizes if left[s]], allowed - wasted)]
        left[top] += 1
        path.append([open_[::-1], None, 0, wasted])
        while path:
            step = path[-1]
            if step[1]:
                for s, n in step[1]:
                    left[s] += n * step[2]
            wasted = step[3]
            if not step[0]:
                path.pop()
                continue
            w, filling = step[0].pop()
            times = min(left[s] // n for s, n in filling)
            if w:
                times = min(times, (allowed - wasted) // w)
            if not times:
                step[1] = None
                continue
            step[1], step[2] = filling, times
            wasted += w * times
            for s, n in filling:
                left[s] -= n * times
            break
        if not path:
            return None
    return None


def plan(counts: dict[int, int], limit: int = LIMIT, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences use each. Deterministic for a histogram."""
    best = best_fit(counts, limit)
    bins = sum(n for _, n in best)
    low = lower_bound(counts, limit)
    while bins > low:
        # straight for the bound first, then for one sequence less
        better = complete(counts, limit, low, nodes) or (
            complete(counts, limit, bins - 1, nodes) if bins - 1 > low else None)
        if better is None:
            break
        best, bins = better, sum(n for _, n in better)
    return best


def places(best: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, how many a sequence, first sequence, offset)``."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for filling, bins in best:
        offset = 0
        for size, n in filling:
            rows.setdefault(size, []).append((rank.get(size, 0), n, sequence, offset))
            rank[size] = rank.get(size, 0) + n * bins
            offset += n * size
        sequence += bins
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


# ---- back to pieces ------------------------------------------------------------


def pack(cut: DataFrame, limit: int = LIMIT, nodes: int = NODES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of a table made by ``pieces``.

    ``cut`` is read three times, so it should be a written table. The rank of a
    piece is its number inside its task plus the pieces of its length in
    earlier tasks; hot lengths therefore never meet in one task.
    """
    tasks = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("n")).collect()}  # at most `limit` rows
    table = places(plan(counts, limit, nodes))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tasks.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = cut.join(firsts, ["length", "part"])

    def place(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = (batch["first"] + batch["nth"]).to_numpy()
            sequence = np.zeros(len(batch), np.int64)
            offset = np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                rows = table[int(length[own[0]])]
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                k = rank[own] - at[:, 0]
                sequence[own] = at[:, 2] + k // at[:, 1]
                offset[own] = at[:, 3] + k % at[:, 1] * length[own]
            batch = batch.drop(columns=["first", "nth", "part"])
            batch["sequence_id"], batch["offset"] = sequence, offset
            yield batch

    kept = ranked.drop("nth", "part", "first")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    columns = [c for c in ranked.columns if c not in ("nth", "part", "first")]
    return ranked.select(*columns, "nth", "part", "first").mapInPandas(
        place, ", ".join(f for c in columns for f in fields if f.startswith(f"`{c}` "))
        + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids``; a group has at most ``limit`` ids."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"),
    ).select("sequence_id", "n_tokens", F.aggregate(
        "own", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))


def packed_digest(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Packs documents; pieces are written once and keep their ids in the shared folder."""
    cut = written(pieces(docs, tokenizer, limit), "pieces")
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return pack(slim, limit)
