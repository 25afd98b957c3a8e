"""Toxicity of texts behind disguise: noisy-channel decoding, then learned evidence.

A written word is read as a lattice of characters: digits and signs may stand
for letters, long repetitions for one or two letters, signs inside a word for
nothing, and spaces around single letters for nothing. The best path
under a character trigram model of the whole corpus (Viterbi) is the restored
word. Words without such marks have one path only and stay as they are. Signs
at an edge of a word are read in both ways, as letters and as decoration.

Evidence is learned from labels outside the held-out fold: words and beginnings
of words, each counted once a document. For each pair of counts (toxic, clean)
the expected number of features by chance is compared with the number found,
which gives a local false discovery rate; a feature's weight mixes its shrunken
toxic share with the base rate by that. Words that merely stand in the same
(often copied) toxic documents would pass too, so features must also explain
toxic documents that stronger features leave unexplained, or keep as varied a
company of explaining features as unrelated toxic documents do. Both are counted
in groups of near copies, against the number of groups that chance would give to
one of so many features, so a rare word counts at any size of the sample. A document
scores its strongest feature. Only text enters a score.

Defined results: a null or empty text scores ``NOTHING``; ids that are null
belong to no fold and carry no label; several labels of a document count as
their largest; null labels are none; without labels every document scores
``NOTHING``; repeated rows are scored row by row; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import held_out, ship, without, written
from runscope.llm.jaccard_join import _sketch, shingle_sets

CUT = 0.3
NOTHING = 0.01            # score of a text without evidence
TRAIN_ROWS = 20_000       # bound on the labelled documents that the evidence is learned from
FALSE_FEATURES = 0.01     # largest local false discovery rate of a feature that counts
PURE = 0.8                # least toxic share of the documents with a feature that counts
RELATED_PURE = 0.95       # the same for longer or shorter forms of a feature that explains documents
COMPANY = 0.5             # least variety of company of such a feature, as part of what its documents would have by chance
COPY_RUNS, COPY_CHAIN = 12, 3    # a pair of near copies at 0.8 shares a key with a chance of 0.9998
PREFIXES = (3, 4, 5, 6)
WORDS_KEPT = 200_000      # words a worker remembers
LONGEST_WORD = 40         # longer runs of characters are read as they are
DOCS_A_BATCH = 256

# ---- character model -------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, CLASSES = 0, 27, 28     # class 0: outside a word; 27: any other letter or digit
_ACCENTS = str.maketrans("àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_CLASS = {c: k + 1 for k, c in enumerate(LETTERS)}
# What a sign may stand for (fixed values), most usual first.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "", "#": "", "_": "",
         "-": "", ".": "", "'": ""}
_MARKED = re.compile(r"[^\W\d_][0-9@$!|+(€£*#_.\-']+[^\W\d_]|^[0-9@$!|+(€£]{1,2}[^\W\d_]|[^\W\d_][0-9@$][^\W_]*$"
                     r"|([^\W\d_])\1\1")
_DECOR = re.compile(r"^[\W_]+(?=\w)|[\s#%&*|!?.,;:\"()\[\]{}<>_'-]+$|\${3,}$")
_EDGES = re.compile(r"^[^\w@$!|+(€£]+(?=.)|[^\w@$!|+(€£]+$")
_EDGE_LETTERS = re.compile(r"^[@$!|+(€£]+[^\W\d_]|[^\W\d_][!|(]{1,2}$")
# Short pieces in a row; those that hold a lone letter (or sign for one) may be words with spaces between.
_SPACED = re.compile(r"(?<!\S)\S{1,4}(?:[ \t\xa0]{1,3}\S{1,4})+(?!\S)")
_LONE = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+(€£])(?!\S)")


def _class_table() -> np.ndarray:
    """Class of every code point below 0x250; letters beyond are ``OTHER`` in a coarse way."""
    out = np.zeros(0x250, np.int64)
    for k in range(0x250):
        c = chr(k).lower().translate(_ACCENTS)[:1]
        out[k] = _CLASS.get(c, OTHER if c.isalnum() else EDGE)
    return out


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``tri, n``: trigrams of character classes over all whole texts, summed in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), DOCS_A_BATCH):
                joined = "  ".join(t for t in column.slice(at, DOCS_A_BATCH).to_pylist() if t)
                points = np.frombuffer(f"  {joined} ".encode("utf-32-le", "replace"), "<u4")
                kinds = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], OTHER)
                total += np.bincount((kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:], minlength=CLASSES**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["tri", "n"])

    ship(docs.sparkSession)
    return docs.select(F.col(text)).mapInArrow(run, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities ``[first, second, third]``; at most 28**3 counts reach the driver."""
    counts = np.zeros(CLASSES**3)
    for tri, n in trigram_counts(docs, text).collect():
        counts[tri] = n
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    singles = counts.sum((0, 1)) + 1
    pairs = counts.sum(0) + 5 * singles / singles.sum()
    smooth = pairs / pairs.sum(1, keepdims=True)
    full = counts + 5 * smooth[None]
    return np.log(full / full.sum(2, keepdims=True))


# ---- channel and decoding --------------------------------------------------------


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may stand for and the log cost of that."""
    out, k = [], 0
    while k < len(word):
        c, n = word[k], 1
        while k + n < len(word) and word[k + n] == c:
            n += 1
        arcs: list[tuple[str, float]] = []
        if c.isalpha():
            if n < 3:
                arcs.append((c * n, 0.0))
            else:
                arcs += [(c, -0.4), (c * 2, -1.2)]
        else:
            stand = SIGNS.get(c)
            for i, letter in enumerate(stand or ""):
                arcs += [(letter * min(n, 2), -0.5 - i)] if n < 3 else [(letter, -1.0 - i)]
            if c.isdigit():
                arcs.append((c * n, -2.5))
            else:
                arcs.append(("", -1.0 if stand == "" else -2.5))
        out.append(arcs)
        k += n
    return out


@lru_cache(1 << 14)
def _kind(c: str) -> int:
    c = c.translate(_ACCENTS)
    return _CLASS.get(c, OTHER if c.isalnum() else EDGE)


_LISTS: list[tuple[np.ndarray, list]] = []


def _nested(model: np.ndarray) -> list:
    """The model as lists, which are read faster one by one; the last model is remembered."""
    if not _LISTS or _LISTS[0][0] is not model:
        _LISTS[:] = [(model, model.tolist())]
    return _LISTS[0][1]


def decode(word: str | list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """Best path of the lattice of a word, or of a given one; ties go to the first arcs."""
    arcs_of = lattice(word) if isinstance(word, str) else word
    chance = _nested(model)
    # a path is its last letters and the path before, so long lattices take linear time
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for arcs in [*arcs_of, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in arcs:
                s, x, y = score + cost, a, b
                for c in letters:
                    z = _kind(c)
                    s += chance[x][y][z]
                    x, y = y, z
                old = after.get((x, y))
                if old is None or s > old[0]:
                    after[x, y] = (s, (letters, path))
        states = after
    path, out = max(states.values(), key=lambda v: v[0])[1], []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def restored(token: str, model: np.ndarray) -> str:
    """A token in lower case without decoration, decoded if it bears marks of disguise."""
    core = _DECOR.sub("", _DECOR.sub("", token))
    if core and len(core) <= LONGEST_WORD and _MARKED.search(core) and not core.isdigit():
        return decode(core, model)
    return core


def readings(token: str, model: np.ndarray) -> list[str]:
    """The restored token, and the word that signs at its edges spell if they are letters."""
    core = restored(token, model)
    edged = _EDGES.sub("", token)
    if len(edged) > LONGEST_WORD or not _EDGE_LETTERS.search(edged):
        return [core]
    arcs = lattice(edged)
    for k in (0, -1):
        arcs[k] = [arc for arc in arcs[k] if arc[0]] or arcs[k]
    spelled = decode(arcs, model)
    return [core] if spelled == core else [core, spelled]


def spaced_words(text: str, model: np.ndarray) -> list[str]:
    """Words of runs of short pieces, where each written space may stand for nothing.

    A run is decoded whole, however long; a space between longer pieces is less likely to go.
    """
    out = []
    if not _LONE.search(text):
        return out
    for run in _SPACED.findall(text):
        if not _LONE.search(run):
            continue
        pieces = run.split()
        arcs: list[list[tuple[str, float]]] = []
        for k, piece in enumerate(pieces):
            if k:
                arcs.append([("", -1.0 * (min(len(piece), len(pieces[k - 1])) - 1)), (" ", 0.0)])
            arcs += lattice(piece)
        out += set(decode(arcs, model).split()).difference(pieces)
    return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)] if word else []


# ---- evidence --------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of labelled documents outside the held-out fold, about ``rows`` of them at most.

    Beyond the bound ids are taken by their hash. The chosen labels are bounded
    and therefore broadcast; texts are not shuffled.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("__id is not null and toxic is not null").filter(~held_out(F.col("__id")))
        .groupBy("__id").agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("__id", F.lit("train")), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text")).join(
        F.broadcast(known), "__id").select("text", "toxic")


def feature_counts(train: DataFrame, model: np.ndarray) -> DataFrame:
    """``feature, toxic, clean``: documents with each feature; features seen in toxic documents only matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        memo = _Memo(lambda token: [f for w in readings(token, model) for f in features(w)])

        def out() -> pa.RecordBatch:
            rows = [(f, a, b) for f, (a, b) in counts.items()]
            counts.clear()
            columns = list(zip(*rows)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                               pa.array(columns[2], pa.int64())], ["feature", "toxic", "clean"])

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_A_BATCH):
                own = batch.slice(at, DOCS_A_BATCH)
                for text, toxic in zip(own.column(0).to_pylist(), own.column(1).to_pylist()):
                    lower = (text or "").lower()
                    seen = {f for token in set(lower.split()) for f in memo[token]}
                    seen.update(f for w in spaced_words(lower, model) for f in features(w))
                    side = 0 if toxic else 1
                    for f in seen:
                        counts.setdefault(f, [0, 0])[side] += 1
                memo.trim()
                if len(counts) > 400_000:
                    yield out()
        yield out()

    ship(train.sparkSession)
    return train.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(counts: DataFrame, toxic_rows: int, clean_rows: int) -> dict[str, float]:
    """Weights of features that stand out; their number is bounded by the training rows.

    For every number of documents the features by (toxic, clean) are compared
    with a binomial at the base rate; grouping happens before anything reaches
    the driver.
    """
    if not toxic_rows or not clean_rows:
        return {}
    # share of toxic documents among all sightings of features: longer toxic texts raise it
    seen = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    base = min(0.45, max(seen[0] / max(seen[0] + seen[1], 1), toxic_rows / (toxic_rows + clean_rows)))
    strong = counts.filter(f"toxic >= 2 and toxic > {2 * base} * (toxic + clean)")
    by_size = counts.select((F.col("toxic") + F.col("clean")).alias("k"))
    # sizes in steps of a sixth: small sizes alone, large ones together
    step = lambda k: F.when(k <= 12, k).otherwise(F.floor(F.log(k) * 6) + 1000).cast("long")
    sizes = {r[0]: r[1] for r in by_size.groupBy(step(F.col("k")).alias("s")).agg(F.count("*")).collect()}
    share = F.round(F.col("toxic") / (F.col("toxic") + F.col("clean")), 1)
    cells = {(r[0], r[1]): r[2] for r in strong.withColumn("k", F.col("toxic") + F.col("clean")).groupBy(
        step(F.col("k")).alias("s"), share.alias("r")).agg(F.count("*")).collect()}
    weights: dict[str, float] = {}
    for feature, toxic, clean in strong.select("feature", "toxic", "clean").toLocalIterator():
        k = toxic + clean
        s = k if k <= 12 else math.floor(math.log(k) * 6) + 1000
        found = cells.get((s, round(toxic / k, 1)), 1)
        chance = min(1.0, sizes.get(s, 1) * _tail(toxic, k, base) / max(found, 1))
        if chance < FALSE_FEATURES and toxic >= PURE * k:
            own = (toxic + base) / (k + 1)
            weight = (1 - chance) * own + chance * base
            if weight > max(2 * base, 0.1):
                weights[feature] = weight
    return weights


def incidence(train: DataFrame, model: np.ndarray, weights: dict[str, float]) -> DataFrame:
    """``seen, toxic, bands``: weighted features of training documents, and keys that near copies share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda word: [f for f in features(word) if f in weights]
        memo = _Memo(lambda token: [f for w in readings(token, model) for f in own(w)])
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(at, DOCS_A_BATCH)
                found, bands = [], []
                for text in batch.column(0).to_pylist():
                    lower = (text or "").lower()
                    seen = {f for token in set(lower.split()) for f in memo[token]}
                    seen.update(f for w in spaced_words(lower, model) for f in own(w))
                    found.append(sorted(seen))
                    bands.append(copy_keys(text) if seen else [])
                memo.trim()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.list_(pa.string())), batch.column(1), pa.array(bands, pa.list_(pa.binary()))],
                    ["seen", "toxic", "bands"])

    return train.mapInArrow(run, "seen array<string>, toxic int, bands array<binary>").filter("size(seen) > 0")


def copy_keys(text: str | None) -> list[bytes]:
    """Keys of a text, of which near copies (0.8 of all runs of five words) share one."""
    own = shingle_sets([text])[0]
    if not len(own):
        return []
    hashes = np.frombuffer(_sketch(own, COPY_RUNS * COPY_CHAIN), "<u4").reshape(COPY_RUNS, COPY_CHAIN)
    return [bytes([k]) + row.tobytes() for k, row in enumerate(hashes)]


def without_copies(rows: list[tuple[list[str], int, list[bytes]]]) -> list[tuple[list[str], int, int]]:
    """``(features, toxic, 1)`` for each group of near copies under one label, with the features of all its texts."""
    root = list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k] = root[root[k]]
        return k

    first: dict[tuple[int, bytes], int] = {}
    for k, (_, toxic, bands) in enumerate(rows):
        for band in bands:
            a, b = top(first.setdefault((toxic, band), k)), top(k)
            root[max(a, b)] = min(a, b)
    merged: dict[int, set[str]] = {}
    for k, (seen, _, _) in enumerate(rows):
        merged.setdefault(top(k), set()).update(seen)
    return [(sorted(seen), rows[k][1], 1) for k, seen in merged.items()]


def least_groups(candidates: int, toxic_share: float) -> int:
    """Toxic groups that none of so many features would have to itself by chance."""
    if not 0 < toxic_share < 1:
        return 2
    return max(2, math.ceil(math.log(FALSE_FEATURES / max(candidates, 1)) / math.log(toxic_share)))


def explaining(sets: list[tuple[list[str], int, int]], weights: dict[str, float],
               toxic_share: float) -> dict[str, float]:
    """The weights of features that explain toxic documents beyond stronger ones, and of their pure forms.

    Features are chosen one by one: the one with most toxic documents not yet
    explained, each clean document costing as many as ``PURE`` allows for. Ties
    go to the longer, then the smaller feature. A frequent feature whose
    documents are all explained counts too if they hold many combinations of
    chosen features. Either way it needs ``least_groups``. ``sets`` holds the
    features of groups of near copies (or of documents, with their number), so
    its size is bounded by ``TRAIN_ROWS``.
    """
    toxic_rows = sum(n for _, toxic, n in sets if toxic)
    least = least_groups(len(weights), toxic_share)
    where: dict[str, list[int]] = {}
    clean: dict[str, int] = {}
    for k, (seen, toxic, n) in enumerate(sets):
        for f in seen:
            if toxic:
                where.setdefault(f, []).append(k)
            else:
                clean[f] = clean.get(f, 0) + n
    cost = PURE / (1 - PURE)
    new = {f: sum(sets[k][2] for k in own) for f, own in where.items()}
    total = dict(new)
    explained: set[int] = set()
    chosen: list[str] = []
    while new:
        best = min(new, key=lambda f: (cost * clean.get(f, 0) - new[f], -len(f.rstrip("*")), f))
        if new[best] < max(least, cost * clean.get(best, 0)):
            break
        chosen.append(best)
        for k in where[best]:
            if k not in explained:
                explained.add(k)
                for f in sets[k][0]:
                    if f in new:
                        new[f] -= sets[k][2]
        new = {f: n for f, n in new.items() if n >= least and f != best}
    first = set(chosen)
    company = {k: frozenset(first.intersection(seen)) for k, (seen, toxic, _) in enumerate(sets) if toxic}
    sizes: dict[frozenset[str], int] = {}
    for k, own in company.items():
        sizes[own] = sizes.get(own, 0) + sets[k][2]
    for f, own in sorted(where.items()):
        m = total[f]
        if f not in first and m >= least and m >= RELATED_PURE * (m + clean.get(f, 0)):
            by_chance = sum(1 - (1 - n / toxic_rows) ** m for n in sizes.values())
            if len({company[k] for k in own}) >= COMPANY * by_chance:
                chosen.append(f)
    stems = [c.rstrip("*") for c in chosen]
    kept = set(chosen)
    for f in weights:
        form = f.rstrip("*")
        if (len(form) > PREFIXES[0] and total.get(f, 0) >= RELATED_PURE * (total.get(f, 0) + clean.get(f, 0))
                and any(s.startswith(form) or (len(s) > PREFIXES[0] and form.startswith(s)) for s in stems)):
            kept.add(f)
    return {f: w for f, w in weights.items() if f in kept}


def _tail(toxic: int, k: int, base: float) -> float:
    """Chance of at least ``toxic`` among ``k`` at the base rate (bounded by its Chernoff form for large ``k``)."""
    if k <= 60:
        return sum(math.comb(k, i) * base**i * (1 - base)**(k - i) for i in range(toxic, k + 1))
    p = toxic / k
    gap = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0)
    return math.exp(-k * gap)


class _Memo(dict):
    """Function of a token with a bounded memory."""

    def __init__(self, of: Callable[[str], object]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> object:
        self[token] = value = self.of(token)
        return value

    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


# ---- scoring ---------------------------------------------------------------------


def scores(docs: DataFrame, model: np.ndarray, weights: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``; all columns ride along, nothing is shuffled."""
    if "score" in docs.columns:
        docs = without(docs, ["score"])
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda word: max((weights.get(f, NOTHING) for f in features(word)), default=NOTHING)
        memo = _Memo(lambda token: max(map(weight, readings(token, model))))
        for big in batches:
            for start in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(start, DOCS_A_BATCH)
                found = []
                for body in batch.column(at).to_pylist():
                    lower = (body or "").lower()
                    score = max(map(memo.__getitem__, set(lower.split())), default=NOTHING)
                    for word in spaced_words(lower, model):
                        score = max(score, weight(word))
                    found.append(score)
                memo.trim()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """Character model of the corpus and evidence of the labels."""
    model = character_model(docs, text)
    train = written(training_rows(docs, labels, doc_id, text, rows), "training")
    counted = feature_counts(train, model).persist()
    sides = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic = sum(n for k, n in sides.items() if k)
    weights = learn(counted, toxic, sum(sides.values()) - toxic)
    counted.unpersist()
    found = [(r["seen"], r["toxic"], [bytes(b) for b in r["bands"]])
             for r in incidence(train, model, weights).toLocalIterator()]
    return model, explaining(without_copies(found), weights, toxic / max(sum(sides.values()), 1))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score``, learned from ``labels`` (``doc_id, toxic``)."""
    model, weights = fit(docs, labels, doc_id, text, rows)
    return scores(docs, model, weights, text)
