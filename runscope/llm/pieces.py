"""Sampled segmentations into pieces, and their way back to the text.

The pieces of a SentencePiece model span a lattice over each text. Forward
filtering sums the weights of all ways to reach each position; backward
sampling walks from the end and picks every piece with its exact conditional
probability. A piece weighs ``rank ** -sharpness`` by its rank in the
vocabulary; characters without a piece are spelled in bytes. Draws come from a
counter-based generator on (seed, row key, position), so a segmentation depends
on its row alone.

Space is written as U+2581, a U+2581 of the text is spelled in bytes, and no
other character is changed, so decoding gives the text back. No piece goes on
after a space mark that follows another character, so the lattice falls into
words; equal words of a batch are filtered once, and all words of a batch are
sampled in step, in arrays.

Defined results: a null text has no pieces and decodes to an empty text; rows
with equal key and text get equal pieces; a null key counts as -1; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import ship

SHARPNESS = 1.0
MARK = "▁"
CHARS_A_BATCH = 1_500_000
_B = np.uint64(0x9E3779B97F4A7C15)
# Stands for a mark of the text itself; no valid text holds a lone surrogate.
_LITERAL = "\ud800"
_WORD = re.compile(f"[{MARK}]+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """The vocabulary as hash tables per piece length."""

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        skip = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        texts: dict[int, str] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
            elif not skip[i]:
                texts[i] = name
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        for name in texts.values():
            if MARK in name.lstrip(MARK) or "\n" in name:
                raise ValueError(f"piece {name!r} crosses a word border")
        scores = {i: model.get_score(i) for i in texts}
        rank = {i: k for k, i in enumerate(sorted(texts, key=lambda i: (-scores[i], i)))}
        total = sum((k + 2.0) ** -sharpness for k in range(len(texts)))
        self.log_p = np.full(size, -np.inf)
        for i, k in rank.items():
            self.log_p[i] = -sharpness * np.log(k + 2.0) - np.log(total)
        self.log_byte = -sharpness * np.log(len(texts) + 2.0) - np.log(total)
        self.names = names
        self.raw = [name.replace(MARK, " ").encode() for name in names]     # what each piece writes
        for k, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([k])
        self.longest = max(map(len, texts.values()))
        self.tables: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (self.longest + 1)
        by_length: dict[int, list[int]] = {}
        for i, name in texts.items():
            by_length.setdefault(len(name), []).append(i)
        self.filter = np.zeros(1 << 20, bool)
        for length, ids in by_length.items():
            keys = np.zeros(len(ids), np.uint64)
            points = np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le"), "<u4").reshape(-1, length)
            for k in range(length):
                keys = (keys + points[:, k] + np.uint64(1)) * _B
            keys = _mix(keys + np.uint64(length))
            if len(np.unique(keys)) != len(keys):
                raise ValueError("pieces share a hash")
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array(ids, np.int64)[order])
            self.filter[(keys >> np.uint64(44)).astype(np.int64)] = True

    def edges(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, piece)`` of all pieces; ``room`` is the distance to the end of the word."""
        starts, lengths, pieces = [], [], []
        at = np.arange(len(points))
        key = np.zeros(len(points), np.uint64)
        for length in range(1, self.longest + 1):
            fits = room[at] >= length
            at, key = at[fits], key[fits]
            if not len(at):
                break
            key = (key + points[at + length - 1] + np.uint64(1)) * _B
            if self.tables[length] is None:
                continue
            full = _mix(key + np.uint64(length))
            maybe = np.flatnonzero(self.filter[(full >> np.uint64(44)).astype(np.int64)])
            keys, ids = self.tables[length]
            where = np.minimum(np.searchsorted(keys, full[maybe]), len(keys) - 1)
            hit = keys[where] == full[maybe]
            starts.append(at[maybe[hit]])
            pieces.append(ids[where[hit]])
            lengths.append(np.full(int(hit.sum()), length))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)


def forward(lattice: Lattice, words: list[str]):
    """Filtered lattices of different words as one table of edges.

    A node is a position behind a character: word ``w`` has nodes
    ``first[w] + 1 .. first[w] + len``. Edges are sorted by the node they end
    in; ``upto`` rises by 2**32 per node, with steps by conditional probability.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - begin[owner]
    start, length, piece = lattice.edges(points, sizes[owner] - place)
    single = np.zeros(len(points), bool)
    single[start[length == 1]] = True
    spelled = np.flatnonzero(~single)             # characters in bytes: piece -(bytes)
    mark = points[spelled]
    count = 1 + (mark > 0x7F).astype(np.int64) + (mark > 0x7FF) + (mark > 0xFFFF)
    start = np.concatenate([start, spelled])
    piece = np.concatenate([piece, -count])
    length = np.concatenate([length, np.ones(len(spelled), np.int64)])
    log_p = np.where(piece >= 0, lattice.log_p[np.maximum(piece, 0)], -piece * -abs(lattice.log_byte))
    end = start + length                           # node number: position of the last character plus one
    order = np.argsort(end * (lattice.longest + 1) - length)     # by end, then by start; no two edges have both alike
    start, end, piece, log_p = start[order], end[order], piece[order], log_p[order]
    step = place[end - 1]
    if len(points) and sizes.max() <= 1 << 16:
        step = step.astype(np.uint16)              # sorted by counting
    by_step = np.argsort(step, kind="stable")
    weight = np.full(len(points) + 1, -np.inf)     # of a node, by its number
    chance = np.empty(len(start))
    bounds = np.r_[0, np.cumsum(np.bincount(step, minlength=int(sizes.max(initial=0))))]
    first = begin[owner]
    for s, e in zip(bounds[:-1], bounds[1:]):
        if s == e:
            continue
        own = by_step[s:e]
        at, to = start[own], end[own]
        value = log_p[own] + np.where(at == first[to - 1], 0.0, weight[at])
        heads = np.flatnonzero(np.r_[True, np.diff(to) != 0])
        top = np.maximum.reduceat(value, heads)
        counts = np.diff(np.r_[heads, e - s])
        share = np.exp(value - np.repeat(top, counts))
        total = np.add.reduceat(share, heads)
        weight[to[heads]] = top + np.log(total)
        chance[own] = share / np.repeat(total, counts)
    heads = np.flatnonzero(np.r_[True, np.diff(end) != 0])
    counts = np.diff(np.r_[heads, len(end)])
    nth = np.arange(len(end)) - np.repeat(heads, counts)
    share = chance.copy()
    for k in range(1, int(counts.max())):          # sums inside a node do not depend on the rest of the batch
        at = np.flatnonzero(nth == k)
        share[at] += share[at - 1]
    upto = np.minimum(np.ceil(share * 2.0**32), 2.0**32).astype(np.int64)
    upto[heads + counts - 1] = 1 << 32
    return begin, sizes, start, end, piece, (end << 32) + upto


def sample(lattice: Lattice, texts: list[str | None], keys: list[int | None], seed: int = 0) -> list[np.ndarray]:
    """One segmentation per text as arrays of piece ids."""
    shown = [(t or "").replace(MARK, _LITERAL).replace(" ", MARK) for t in texts]
    split = [_WORD.findall(t) for t in shown]
    flat = [w for own in split for w in own]
    if not flat:
        return [np.zeros(0, np.int64) for _ in texts]
    different = list(dict.fromkeys(flat))
    index = {w: i for i, w in enumerate(different)}
    kind = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    begin, sizes, e_start, _, e_piece, upto = forward(lattice, different)
    # occurrences of words: place in the text and seed of the row
    n_words = np.array([len(own) for own in split], np.int64)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    length = sizes[kind]
    ends = np.cumsum(length)
    text_first = np.r_[0, np.cumsum([len(t) for t in shown])[:-1]]
    offset = ends - length - text_first[text_of]
    row = _mix(np.array([-1 if k is None else k for k in keys], np.int64).astype(np.uint64)
               + np.uint64(seed % 2**64) * _B)[text_of]
    # walk back from the ends of all words in step, equal words side by side as their edges are
    live = np.argsort(kind, kind="stable")
    node = (begin[kind] + length)[live]
    words_s, pieces_s, nodes_s = [], [], []
    while len(live):
        draw = _mix(row[live] ^ _mix((offset[live] + node - begin[kind[live]]).astype(np.uint64)))
        edge = np.searchsorted(upto, (node << 32) + (draw >> np.uint64(32)).astype(np.int64), side="right")
        words_s.append(live)
        pieces_s.append(e_piece[edge])
        nodes_s.append(node)
        node = e_start[edge]
        going = node > begin[kind[live]]
        live, node = live[going], node[going]
    # into reading order: by word occurrence, then steps from the last to the first
    counts = np.bincount(np.concatenate(words_s), minlength=len(flat))
    last = np.cumsum(counts) - 1
    found = np.empty(int(counts.sum()), np.int64)
    at_node = np.empty(len(found), np.int64)
    for k, (own, piece, node) in enumerate(zip(words_s, pieces_s, nodes_s)):
        found[last[own] - k] = piece
        at_node[last[own] - k] = node
    # spelled characters become their bytes
    wide = np.where(found < 0, -found, 1)
    of_text = np.repeat(text_of, counts)
    per_text = np.bincount(of_text, weights=wide, minlength=len(texts)).astype(np.int64)
    target = np.cumsum(wide) - wide
    out = np.empty(int(wide.sum()), np.int64)
    plain = found >= 0
    out[target[plain]] = found[plain]
    if not plain.all():
        characters = "".join(different)
        for t, node in zip(target[~plain].tolist(), at_node[~plain].tolist()):
            c = characters[node - 1]
            spelled = np.frombuffer((MARK if c == _LITERAL else c).encode(), np.uint8)
            out[t:t + len(spelled)] = lattice.byte_ids[spelled]
    return np.split(out, np.cumsum(per_text)[:-1])


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    """The text of a segmentation."""
    raw = lattice.raw
    return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8")


_LATTICES: dict[tuple[str, float], Lattice] = {}


def lattice_of(path: str, sharpness: float = SHARPNESS) -> Lattice:
    if (path, sharpness) not in _LATTICES:
        _LATTICES[path, sharpness] = Lattice(path, sharpness)
    return _LATTICES[path, sharpness]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        keys.append(key)
        texts.append(text)
        held += len(text or "")
        if held >= CHARS_A_BATCH:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def sampled_pieces(docs: DataFrame, model: str, seed: int = 0, sharpness: float = SHARPNESS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids, lossless``: ids as little-endian unsigned 32-bit; a narrow step.

    ``lossless`` tells that decoding the ids gives the text back.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()),
                        ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, sharpness)
        for batch in batches:
            for keys, texts in _slices(batch):
                found = sample(lattice, texts, keys, seed)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                    pa.array([decode(lattice, x) == (t or "") for x, t in zip(found, texts)], pa.bool_())],
                    schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, n_pieces long, ids binary, lossless boolean")


def decoded(pieces: DataFrame, model: str, sharpness: float = SHARPNESS) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, sharpness)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [decode(lattice, np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "text"])

    ship(pieces.sparkSession)
    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
