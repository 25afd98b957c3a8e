"""Prefix trie, shortest-pack-first packing and vector codes against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runscope.llm import histogram_packing, prefix_trie, vector_codes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, path binary, shard int, kind string"
VECTORS = "vec_id long, embedding array<float>, label int, code string, dim string, data int"


# ---- prefix trie -----------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = [t[3:] for t in sorted(own.get(conv - int(math.fmod(conv, 5)), []))]
        whole = tuple(first[:h] + [t[3:] for t in sorted(turns)][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
            if d:
                kids[whole[:d - 1]].add(whole[:d])
        ends[whole].append(conv)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(below), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return Counter(out)


def conversations():
    rng = random.Random(4)
    rows = [(rng.choice([None, 0, 1, 2, 3, 4, 5, 9, 10, -3, 12, 10**15]), rng.choice([None, 0, 1, 2, 2]),
             rng.choice(["user", None, "", "a:"]), rng.choice(["x", "yß😀", None, "y" * 5000])) for _ in range(250)]
    rows += [(100 + i, j, "user", "same") for i in range(400) for j in range(3)]     # a hot sequence
    rows += [(1000 + i, j, "user", f"{'deep' if j < 40 else i}") for i in range(12) for j in range(60)]
    rows += [(77, None, None, None)] * 5
    return rows


@pytest.mark.parametrize("shard_turns", [15, 200, 10**6])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = conversations()
    df = spark.createDataFrame([(*r, b"p", 3, "k") for r in rows], TURNS).repartition(4)
    found = prefix_trie.conversation_trie(df, shard_turns)
    assert tuple(found.columns) == prefix_trie.COLUMNS
    assert Counter(map(tuple, found.collect())) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "t", None, 1, "")], TURNS)).collect() == []


def test_ternary_tree_lists_prefixes_first_and_in_order():
    rng = random.Random(2)
    words = sorted({tuple(rng.randrange(4) for _ in range(rng.randrange(6))) for _ in range(300)})
    tree = prefix_trie.TernaryTree()
    assert sorted(prefix_trie.medians(len(words))) == list(range(len(words)))
    for k in prefix_trie.medians(len(words)):
        tree.insert(list(words[k]))

    def path(node):
        return () if node == 0 else (*path(tree.parent[node]), tree.symbol[node])

    nodes = [path(n) for n in tree.in_order()]
    assert nodes == sorted({w[:d] for w in words for d in range(len(w) + 1)})


def test_blocks_of_ids_are_hashed_as_one_text(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    rows = [(i, j, "u", "t") for i in range(500) for j in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, prefix_trie.conversation_trie(df, 30).collect())) == plain_trie(rows)


# ---- packing ---------------------------------------------------------------------


def laid_out(counts, limit):
    """Pieces of all documents of a histogram by its plan; checks that they cover the documents."""
    made = histogram_packing.plan(counts, limit)
    sequences, pieces = defaultdict(list), 0
    for length, n in counts.items():
        for rank in range(n):
            at = 0
            for start, tokens, sequence, offset in histogram_packing.places(made, length, rank):
                assert start == at and tokens > 0
                at += tokens
                pieces += 1
                sequences[sequence].append((offset, tokens))
            assert at == length
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, tokens in sorted(own):
            assert offset == at
            at += tokens
        assert at <= limit
        padding += limit - at if at & (at - 1) else 0
    assert set(sequences) == set(range(made.sequences))
    return pieces, len(sequences), padding


@pytest.mark.parametrize("limit", [1, 2, 16, 256])
def test_plans_have_no_padding_and_lose_nothing(limit):
    rng = random.Random(limit)
    for _ in range(60):
        counts = {rng.randint(1, limit): rng.choice([1, 2, 7, 60]) for _ in range(rng.randint(0, 12))}
        tokens = sum(s * n for s, n in counts.items())
        _, sequences, padding = laid_out(counts, limit)
        assert padding == 0
        # open packs and the powers of two behind the last gap
        assert sequences >= -(-tokens // limit)


def test_few_documents_are_cut():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(50_000))
    pieces, sequences, padding = laid_out(counts, 2048)
    assert padding == 0
    assert pieces < 1.01 * 50_000
    assert sequences <= -(-sum(s * n for s, n in counts.items()) // 2048) + 11


def test_shortest_pack_gets_the_next_length():
    packs = histogram_packing.shortest_pack_first({7: 1, 5: 2, 3: 1, 2: 1}, 10)
    # 7 | 7, 5 -> 5 alone, 5+5 full; the 3 goes to the 7
    assert packs == {10: {((5, 2),): 1, ((7, 1), (3, 1)): 1}, 2: {((2, 1),): 1}}
    assert histogram_packing.shortest_pack_first({4: 5}, 10) == {8: {((4, 2),): 2}, 4: {((4, 1),): 1}}


def test_plans_grow_with_lengths_not_with_documents():
    counts = {s: 10**9 + s for s in range(1, 2049)}
    made = histogram_packing.plan(counts, 2048)
    assert sum(map(len, made.whole.values())) < 60_000 and len(made.gaps) < 60_000


TEXTS = [(1, "One short text."), (2, None), (3, ""), (None, "no id"), (5, "same"), (5, "same"),
         (6, " ".join(f"word{k * 7919 % 1000}" for k in range(4000))), (7, "zwei \x00 Maß 😀 <|endoftext|>")]


def test_packed_pieces_are_the_library_s_ids(spark):
    rng = random.Random(3)
    texts = TEXTS + [(100 + k, " ".join(["lorem"] * rng.randrange(700))) for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in texts], "doc_id long, text string, nth int, part string, start int")
    rows = histogram_packing.packed(df.repartition(5), WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, np.array(ids, "<u4").tobytes()] += 1
    cuts = {r.doc_id: set() for r in rows}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
        cuts[r.doc_id].add((r.start, r.length, bytes(r.ids)))
    for (doc, ids), n in want.items():
        for start, length, own in cuts[doc]:
            assert ids[4 * start:4 * (start + length)] == own
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    joined = {r.sequence_id: r for r in histogram_packing.sequences(
        histogram_packing.packed(df, WORD_BPE)).collect()}
    assert all(len(r.ids) == 4 * r.n_tokens <= 8192 for r in joined.values())
    assert all(r.n_tokens == 2048 or r.n_tokens & (r.n_tokens - 1) == 0 for r in joined.values())


def test_ranks_that_are_not_broadcast_give_the_same_pieces(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS * 3, "doc_id long, text string").repartition(3)
    cut = histogram_packing.written(histogram_packing.items(df, WORD_BPE), "t-items")
    want = sorted(map(tuple, histogram_packing.pack(cut, "<u2").drop("ids").collect()), key=repr)
    monkeypatch.setattr(histogram_packing, "RANKS_BROADCAST", 0)
    assert sorted(map(tuple, histogram_packing.pack(cut, "<u2").drop("ids").collect()), key=repr) == want


def test_packing_of_nothing(spark):
    assert histogram_packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORD_BPE).collect() == []


# ---- vector codes ----------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes()))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[k * width:(k + 1) * width]) for _, v, _ in kept] for k in range(parts)]
    books = [[tuple(v[k * width:(k + 1) * width]) for _, v, _ in order[:entries]] for k in range(parts)]

    def nearest(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = defaultdict(list)
            for p in cut[k]:
                groups[nearest(p, books[k])[1]].append(p)
            for n, own in groups.items():
                books[k][n] = tuple(sum(c) // len(own) for c in zip(*own))
    done = [[nearest(p, books[k]) for p in cut[k]] for k in range(parts)]
    errors = [sum(done[k][r][0] for k in range(parts)) for r in range(len(kept))]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{done[k][r][1]:02x}" for k in range(parts)), errors[r], by_label[lab], digest)
                   for r, (i, _, lab) in enumerate(kept))


def vectors():
    rng = random.Random(6)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rng.gauss(0, 0.3)) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(1000 + i, [0.5] * 8, 3) for i in range(60)] + [(7, [0.5] * 8, 3), (7, [0.5] * 8, 3)]
    rows += [(None, [0.25] * 8, None), (500, None, 1), (501, [], 1), (502, [1.0] * 7 + [None], 1),
             (503, [1.0] * 7 + [float("nan")], 1), (504, [float("inf")] + [1.0] * 7, 2), (-5, [-0.0009] * 8, 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", 1) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("entries, rounds", [(16, 4), (256, 2), (1, 1)])
def test_codes_equal_brute_force(spark, entries, rounds):
    found = vector_codes.compressed(frame(spark, vectors()), 4, entries, rounds).drop("label")
    assert Counter(map(tuple, found.collect())) == plain_codes(vectors(), 4, entries, rounds)


def test_labels_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS_BROADCAST", 0)
    found = vector_codes.compressed(frame(spark, vectors()), 4, 16, 1).drop("label")
    assert Counter(map(tuple, found.collect())) == plain_codes(vectors(), 4, 16, 1)


def test_codes_of_nothing_and_errors(spark):
    assert vector_codes.compressed(frame(spark, [])).collect() == []
    assert vector_codes.compressed(frame(spark, [(1, None, 1), (2, [], 2)])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(frame(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 4, 2)]))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(frame(spark, [(1, [0.5] * 6, 1)]))
    with pytest.raises(Exception, match="no exact distance"):
        vector_codes.compressed(frame(spark, [(1, [3e30] * 8, 1)]))


def test_limbs_give_exact_products():
    rng = random.Random(1)
    for width, top in ((16, 2**28), (1, 2**30), (1000, 2**20), (3, 5), (64, 2**26)):
        x = np.array([[rng.randint(-top, top) for _ in range(width)] for _ in range(9)])
        y = np.array([[rng.randint(-top, top) for _ in range(width)] for _ in range(7)])
        bits = vector_codes.limb_bits(width)
        assert width << (2 * bits) <= 2**53
        for limb in vector_codes.limbs(x, bits)[:-1]:
            assert limb.min() >= 0 and limb.max() < 2**bits
        assert sum(l.astype(object) * 2**(bits * k) for k, l in enumerate(vector_codes.limbs(x, bits))).tolist() == x.tolist()
        assert (vector_codes.exact_products(x, y) == x.astype(object) @ y.T.astype(object)).all()


def test_nearest_takes_the_first_of_equal_entries():
    code, distance = vector_codes.nearest_entries(np.array([[2, 0], [5, 5]]), np.array([[9, 9], [1, 0], [3, 0], [5, 5], [5, 5]]))
    assert code.tolist() == [1, 3] and distance.tolist() == [1, 0]
