"""Every stage of the corpus pipeline against plain Python, on a table with hard rows."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from runscope.llm import quality_rules, toxicity
from runscope.llm.common import written

DDL = "doc_id long, text string, source string, lang string, score double, kept string, n_words int, row_key string, label long, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubdfglmnprst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randrange(15, 70))
        if i % 6 == 0:
            text = f"{text} zorgface {prose(12)}"
        labels.append((i, int(i % 6 == 0)))
        rows.append((i, text, f"h{i % 5}.org"))
    for i in range(240, 270):       # a host whose texts mostly fail
        rows.append((i, prose(4) if i % 10 else prose(40), "bad.net"))
    family = prose(120).split()
    for i in range(270, 280):       # near copies and copies
        own = list(family)
        own[i % 7] = words[i] if i % 2 else own[i % 7]
        rows.append((i, " ".join(own), "h1.org"))
    again = "a b c d e f g h i j k l m n o"
    rows += [(280, None, "h1.org"), (281, "", "h1.org"), (None, prose(30), None), (282, again, None), (282, again, None),
             (283, prose(6000), "h2.org"), (284, prose(20), "")]
    return [(i, t, s, "en", 0.9, "no", 3, "k", 1, "h") for i, t, s in rows], labels + [(0, None), (None, 1), (6, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = table()
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows before the first stage and after each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), name.replace(" ", "-")))
    return out


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def failed(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    return len(words) < 10 or 100 * len(repeated) > 20 * len(words)


def test_quality_keeps_what_the_rules_and_hosts_keep(steps):
    rows = [tuple(r) for r in steps[0].collect()]
    hosts = {}
    for r in rows:
        if r[2] is not None:
            n, bad = hosts.get(r[2], (0, 0))
            hosts[r[2]] = n + 1, bad + failed(r[1])
    mean = (sum(b for _, b in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    spread = float(np.var([b / n for n, b in hosts.values()]))
    strength = max(1.0, min(1000.0, mean * (1 - mean) / spread - 1))
    rejected = set()
    for host, (n, bad) in hosts.items():
        a, total = bad + strength * mean, n + strength
        sd = (a * (total - a) / (total * total * (total + 1))) ** 0.5
        if a / total - quality_rules.HOST_SIGMAS * sd > quality_rules.HOST_MAX_FAILURE:
            rejected.add(host)
    assert rejected == {"bad.net"}
    want = Counter(r for r in rows if not failed(r[1]) and r[2] not in rejected)
    assert counted(steps[1]) == want and steps[1].columns == steps[0].columns
    assert want[next(r for r in rows if r[0] == 282)] == 2


def test_toxicity_rejects_what_its_scores_tell(spark, folder, steps):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model, weights = toxicity.fit(steps[1], labels)

    def score(text):
        lower = (text or "").lower()
        read = [w for token in lower.split() for w in toxicity.readings(token, model)] + toxicity.spaced_words(lower, model)
        return max((weights.get(f, toxicity.NOTHING) for w in read for f in toxicity.features(w)), default=toxicity.NOTHING)

    rows = counted(steps[1])
    assert counted(steps[2]) == Counter({r: n for r, n in rows.items() if score(r[1]) < toxicity.CUT})
    kept = {r.doc_id for r in steps[2].collect()}
    assert not {i for i in range(0, 240, 6)} & kept and {i for i in range(240) if i % 6} <= kept


def test_one_row_of_each_group_of_near_copies_stays(steps):
    rows = [tuple(r) for r in steps[2].collect()]
    sets = []
    for r in rows:
        words = (r[1] or "").lower().split()
        k = min(5, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = Counter(min((rows[k] for k in range(len(rows)) if group[k] == g), key=lambda r: (r[0] is None, r[0] or 0))
                   for g in set(group))
    assert counted(steps[3]) == want and len(want) < len(rows) - 9


def test_packing_holds_all_tokens_of_what_is_left(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[3].collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        for start in range(0, n, 4096):
            want[r.doc_id, start, min(4096, n - start)] += 1
    rows = steps[4].collect()
    assert Counter((r.doc_id, r.start, r.length) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r.length for r in rows) // 4096)


def test_the_whole_run_gives_the_same_and_stands_empty_tables(spark, folder, steps, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(steps[4])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
