"""Operators for training data against brute force, with hard rows in every table."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runscope.llm import (
    jaccard_join,
    licenses,
    packing,
    pieces,
    quality_rules,
    sharding,
    token_files,
    tokens,
    toxicity,
    url_reputation,
    vector_search,
)
from runscope.llm.common import written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(5)
LONG = " ".join(f"w{RNG.randrange(3000)}" for _ in range(9000))
NOTICE = "Released under the MIT License."
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again."), (2, "the quick brown fox jumps over the lazy dog again and again."),
    (3, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, LONG + " tail"), (None, "a null id has a text of its own"),
    (8, "zwei  Leerzeichen\r\n\tüber ▁ Maß 😀 \x00 <|endoftext|> don't"), (8, "another text of the same id"),
    (9, "same row"), (9, "same row"), (10, f"start {NOTICE}\nmiddle\n{NOTICE} end"), (11, "x" * 3000),
]
DDL = "doc_id long, text string, source string, score double, slot int, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s" if i != 5 else None, 0.5, 7, "x") for i, t in TEXTS], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_memo_gives_the_ids_of_the_library(path):
    encode = tokens.encoder(path)
    rng = random.Random(1)
    extra = ["".join(rng.choice(" \n\tabÉß.,$'s1<|") for _ in range(40)) for _ in range(150)]
    for text in [t for _, t in TEXTS] + extra:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(path, text), repr(text)


def test_packing_is_gapless_and_complete(docs, empty):
    cut = written(packing.pieces(docs, WORD_BPE), "t-pieces")
    rows = packing.pack(cut).collect()
    want = Counter()
    for doc, text in TEXTS:
        ids = ids_of(WORD_BPE, text) + [1]
        for k in range(0, len(ids), 4096):
            want[doc, k // 4096, k, np.array(ids[k:k + 4096], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    counts = Counter(r.length for r in rows)
    assert len(sequences) == packing.lower_bound(counts, 4096)
    joined = packing.sequences(packing.pack(cut)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in rows)
    assert packing.packed_digest(empty, WORD_BPE).count() == 0


def test_bin_completion_finds_optimum_that_best_fit_misses():
    counts = Counter([6, 5, 5, 4, 4, 3, 3])     # fits three bins of ten
    assert sum(n for _, n in packing.plan(counts, 10)) == 3
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        best = optimum(sizes, 20)
        plan = packing.plan(Counter(sizes), 20)
        assert sum(n for _, n in plan) == best
        assert Counter(s for f, n in plan for s, k in f for _ in range(n * k)) == Counter(sizes)


def optimum(sizes, limit):
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1:])
        go(k + 1, rooms + [limit - sizes[k]])

    go(0, [])
    return best[0]


def test_token_files_give_every_id_back_in_order(docs, empty):
    rows = sorted(token_files.written_and_read(docs, BYTE_BPE).collect(), key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == sorted(-1 if i is None else i for i, _ in TEXTS)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = Counter((i, np.array(ids_of(BYTE_BPE, t) + [0], "<u4").tobytes()) for i, t in TEXTS)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert token_files.written_and_read(empty, BYTE_BPE).count() == 0


def test_code_of_ranks():
    rng = np.random.default_rng(2)
    docs = [np.array([], np.uint32), np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32),
            rng.integers(0, 2**20, 1001, dtype=np.uint32)]
    names, counts, ranks = token_files.unpack_block(token_files.pack_block([None, -5, 7], docs))
    assert names == [None, -5, 7] and counts.tolist() == [0, 7, 1001]
    assert ranks.tolist() == np.concatenate(docs).tolist()
    with pytest.raises(ValueError):
        token_files.unpack_block(token_files.pack_block([1], [docs[1]])[:-1])


def test_pieces_are_decoded_from_one_table_of_bytes():
    lattice = pieces.lattice_of(PIECES)
    text = "a\u2581b \U0001f9ec caf\u00e9\n" + "xy" * 33_000     # a word longer than 65,536 characters
    ids, other = pieces.sample(lattice, [text, ""], [7, 8])
    assert b"".join(lattice.raw[i] for i in ids.tolist()) == text.encode() and not len(other)
    assert pieces.decode(lattice, ids.astype("<u4")) == text
    assert [lattice.raw[i] for i in lattice.byte_ids.tolist()] == [bytes([k]) for k in range(256)]
    alone = pieces.sample(lattice, ["caf\u00e9 the the cat"], [7])[0]
    among = pieces.sample(lattice, ["the", "caf\u00e9 the the cat", "cat zebra the"], [1, 7, 2])[1]
    assert alone.tolist() == among.tolist()


def test_sampled_pieces_are_reproducible_and_lossless(docs, empty):
    rows = pieces.sampled_pieces(docs, PIECES).collect()
    assert all(r.lossless for r in rows)
    again = pieces.sampled_pieces(docs.repartition(7), PIECES).collect()
    key = lambda rs: Counter((r.doc_id, bytes(r.ids)) for r in rs)
    assert key(rows) == key(again) and key(rows) != key(pieces.sampled_pieces(docs, PIECES, seed=1).collect())
    back = pieces.decoded(pieces.sampled_pieces(docs, PIECES), PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in TEXTS)
    assert pieces.sampled_pieces(empty, PIECES).count() == 0


def test_samples_follow_the_distribution_of_the_lattice():
    lattice = pieces.lattice_of(PIECES)
    word = "▁tion"
    ways = {}

    def walk(at, path, log_p):
        if at == len(word):
            ways[tuple(path)] = log_p
        for end in range(at + 1, len(word) + 1):
            for i, name in enumerate(lattice.names):
                if name == word[at:end] and np.isfinite(lattice.log_p[i]):
                    walk(end, [*path, i], log_p + lattice.log_p[i])

    walk(0, [], 0.0)
    total = sum(np.exp(v) for v in ways.values())
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in pieces.sample(lattice, [" tion"] * n, list(range(n))))
    assert set(seen) <= set(ways)
    for way, log_p in ways.items():
        p = np.exp(log_p) / total
        assert abs(seen[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-9


def test_licenses(docs, empty):
    rows = licenses.license_places(docs).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in rows] == [(10, "mit-line", 1.0)] * 2
    assert sorted(r.start_word for r in rows) == [1, 7]
    assert licenses.license_places(empty).count() == 0
    text = licenses.words_of("Licensed, so to say, under the old Apache License, in its Version 2.0.")
    assert [b for _, b in licenses.align(text, licenses.words_of(licenses.TEMPLATES["apache-2.0-line"]))] == list(range(8))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_scan_finds_what_aligning_the_whole_text_finds(name):
    split = {k: licenses.words_of(body) for k, body in licenses.TEMPLATES.items()}
    vocabulary = {w for own in split.values() for w in own}
    rng = random.Random(12)
    for most in (0, 1, 5, 10):
        noise = lambda n: [f"{rng.randrange(10**6)}x" for _ in range(n)]
        text = noise(30)
        for w in split[name]:
            text += [w, *noise(most)]
        assert len(licenses.align(text, split[name])) == len(split[name])
        found = [r for r in licenses.scan(text, split, vocabulary) if r[0] == name]
        assert [(r[1], r[2]) for r in found] == [(1.0, 30)], most
    words = licenses.words_of("Licensed under the Apache License a b c d e Version 2.0")
    assert ("apache-2.0-line", 1.0, 0, 13) in licenses.scan(words, split, vocabulary)


def test_nearest_equals_brute_force_also_in_the_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 300, rows[i][1]) for i in range(40)]
    rows += [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8), (550, [1.0] * 7), (600, []), (None, [1.0] * 8),
             (650, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.array(v, np.float64) for i, v in rows[:340]}
    want = set()
    for q in [i for i in good if i % 50 == 0]:
        score = lambda i: vector_search.dot(good[q][None], good[i][None])[0] / (
            np.sqrt(vector_search.dot(good[q][None], good[q][None])[0])
            * np.sqrt(vector_search.dot(good[i][None], good[i][None])[0]))
        best = sorted((-score(i), i) for i in good if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for bound in (1 << 25, 100):
        got = vector_search.nearest(df, df.filter("vec_id % 50 = 0"), 5, broadcast_bytes=bound, groups=3)
        assert {tuple(r) for r in got.collect()} == want
    assert vector_search.nearest(df.limit(0), df.limit(0)).count() == 0


def near_texts():
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"t{rng.randrange(400)}"
            texts.append(" ".join(own))
    return [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0]), (902, texts[0]), (None, texts[1])]


@pytest.mark.parametrize("limit,block", [(2048, 512), (2, 2)])
def test_jaccard_join_finds_all_links(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join.paths_of, "__defaults__", (limit, 3))
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(df).collect())
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j]
              and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        want[doc, min(names) if names else None, len(links[i])] += 1
    if limit > 2:
        assert got == want
    else:       # split on purpose down to paths of two: recall is a probability
        assert sum((got & want).values()) >= 0.9 * sum(want.values())
    kept = jaccard_join.drop_near_copies(df).collect()
    classes = Counter(c for (_, c, _), n in want.items() for _ in range(n))
    if limit > 2:
        assert len(kept) == len(classes)
    assert jaccard_join.miss_probability() < 1e-6


def test_pairs_at_the_threshold_share_a_path_when_all_paths_are_split(spark):
    pairs = 1500
    rng = np.random.default_rng(11)
    texts = []
    for k in range(pairs):      # 36 runs of five words in common, 45 in all: a similarity of 0.8
        base = [f"p{k}w{i}" for i in range(40)]
        texts += [" ".join([*base, *(f"x{rng.integers(1 << 40)}" for _ in range(5))]),
                  " ".join([*base, *(f"y{rng.integers(1 << 40)}" for _ in range(4))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = jaccard_join.sets_of(df)
    pair_of = {bytes(r.node): r.doc_id // 2 for r in sets.select("node", "doc_id").collect()}
    met = {}
    for r in jaccard_join.paths_of(jaccard_join.nodes_of(sets), limit=1).select("path", "node").collect():
        met.setdefault((r.path, pair_of[bytes(r.node)]), set()).add(bytes(r.node))
    assert len({pair for (_, pair), own in met.items() if len(own) == 2}) == pairs
    for level in range(1, jaccard_join.DEPTH + 1):
        assert jaccard_join.miss_probability(0.8, level, jaccard_join.runs_of(level)) <= 1e-6 / jaccard_join.DEPTH * 1.001


def test_restored_words_and_scores(spark):
    rng = random.Random(6)
    clean = [f"{rng.choice(['the', 'small', 'green', 'river', 'runs', 'idle'])} {rng.choice(['house', 'stone', 'tree'])}" for _ in range(60)]
    rows = [(i, " ".join(rng.choices(clean, k=12)) + (" you idiot" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000, "an 1d10t here"), (1001, "i d i o t"), (1002, "idiooooot"), (1003, None), (1004, ""), (1005, "a tree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model, weights = toxicity.fit(docs, labels)
    assert toxicity.restored("1d10t", model) == "idiot" and toxicity.restored("idiooooot!!", model) == "idiot"
    assert toxicity.restored("tree$$$", model) == "tree" and toxicity.restored("don't", model)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model, weights).collect()}
    assert all((got[i] >= toxicity.CUT) == (i % 4 == 0) for i in range(400))
    assert [got[i] >= toxicity.CUT for i in range(1000, 1006)] == [True, True, True, False, False, False]
    assert toxicity.judge(docs.limit(0), labels.limit(0)).count() == 0


@pytest.fixture(scope="module")
def prose_model(spark):
    text = "you are a stupid idiot and such a loser said the old man at a small green house he is an asshole too what a day it is"
    return toxicity.character_model(spark.createDataFrame([(text,)] * 50, "text string"))


@pytest.mark.parametrize("text,words", [
    ("you are a s t u p i d", {"stupid"}), ("s t u p i d i d i o t", {"stupid", "idiot"}), ("such a st u pid man", {"stupid"}),
    ("t h e o l d m a n s a i d y o u a r e a s t u p i d i d i o t a n d a l o s e r", {"stupid", "idiot", "loser"}),
    ("h e i s o l d", {"old"}), ("it is a day", set())])
def test_words_in_spaced_letters(prose_model, text, words):
    got = set(toxicity.spaced_words(text, prose_model))
    assert got >= words and (words or not got)


def test_signs_at_the_edges_of_words_may_be_letters(prose_model):
    for token, word in [("$tupid", "stupid"), ("@sshole", "asshole"), ("!diot", "idiot"), ("|oser", "loser"), ("(idiot)", "idiot")]:
        assert word in toxicity.readings(token, prose_model), token


def test_rare_words_count_by_evidence_and_near_copies_once():
    rng = random.Random(9)
    body = lambda: " ".join(f"b{rng.randrange(10**6)}" for _ in range(60))
    rows = [(["common"], 1, toxicity.copy_keys(body())) for _ in range(1985)]
    rows += [(["rare"], 1, toxicity.copy_keys(body())) for _ in range(15)]
    copied = body()
    rows += [(["copied"], 1, toxicity.copy_keys(f"{copied} {k}")) for k in range(100)]
    groups = toxicity.without_copies(rows)
    assert sum("copied" in seen for seen, _, _ in groups) == 1 and sum("rare" in seen for seen, _, _ in groups) == 15
    weights = {"common": 0.99, "rare": 0.95, "copied": 0.98}
    assert set(toxicity.explaining(groups, weights, 0.1)) == {"common", "rare"}


def test_quality_shards_and_urls_stand_hard_rows(spark, docs, empty):
    base = written(quality_rules.with_base_rules(docs).drop("text"), "t-base")
    judged = quality_rules.judge(base, quality_rules.host_verdicts(base))
    assert judged.count() == len(TEXTS)
    row = judged.filter("doc_id = 3").first()
    assert (row.n_words, row.base_failed, row.kept) == (0, True, False)
    assert judged.filter("doc_id = 6").first().kept
    none = quality_rules.with_base_rules(empty)
    assert quality_rules.judge(none, quality_rules.host_verdicts(none)).count() == 0
    placed = sharding.assign(docs, "doc_id", fallback="text")
    assert placed.count() == len(TEXTS) and placed.filter("doc_id = 9").select("shard").distinct().count() == 1
    before, after = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[1:])
    sizes = Counter(before)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(sharding.SHARDS[a] != sharding.SHARDS[1:][b] for a, b in zip(before, after))
    assert moved < 0.1 * sharding.SLOTS
    pages = spark.createDataFrame(
        [(1, "http://A.Bad.com/x?q"), (2, "https://good.co.uk#f"), (3, None), (4, "no scheme"), (5, "http://x.net/en/"),
         (5, "http://x.net/en/")], "page_id long, url string")
    many = pages.unionByName(spark.range(100, 400).select(
        F.col("id").alias("page_id"), F.when(F.col("id") < 250, "http://a.bad.com/").otherwise("http://ok.org/").alias("url")))
    outcomes = spark.range(100, 400).select(F.col("id").alias("page_id"), (F.col("id") < 250).cast("int").alias("bad"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_pages(
        many, outcomes, (("net", "/en", "allow"),)).filter("page_id < 100").collect()}
    assert got >= {(1, "a.bad.com", "/x", None, "block"), (5, "x.net", "/en/", "net/en", "allow")}
    assert {p for p, *_ in got} == {1, 2, 3, 4, 5}
    assert url_reputation.judge_pages(pages.limit(0), outcomes.limit(0)).count() == 0


def test_checksum():
    assert token_files.checksum(b"abcd") == zlib.crc32(b"abcd")
