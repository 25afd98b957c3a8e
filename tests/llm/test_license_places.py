"""License places: ordinary prose has none, other words count, and the cost grows with the text."""

import random
import time

import duckdb
import pytest

from runscope.llm import licenses

SPLIT = {name: licenses.words_of(body) for name, body in licenses.TEMPLATES.items()}
VOCABULARY = {w for own in SPLIT.values() for w in own}


def scan(text):
    return licenses.scan(licenses.words_of(text), SPLIT, VOCABULARY)


@pytest.mark.parametrize("text", [
    "All guests know their rights. Seats are reserved for members only.",
    "The software was released last year by a team working under contract for the university at MIT.",
    "Licensed plumbers working under the supervision of CC Smith are paid by the hour, by NC rules, from 4 to 0.",
    "The album was released in May under the label that the MIT choir had founded, whose license expired in 2003.",
    "Permission to enter is granted, free of charge, to any person who has obtained a copy of the ticket.",
])
def test_prose_has_no_place(text):
    assert scan(text) == []


@pytest.mark.parametrize("name", sorted(SPLIT))
def test_other_words_count_and_words_with_digits_do_not(name):
    template, rng = SPLIT[name], random.Random(4)
    most = int(licenses.FOREIGN * len(template))
    for other in range(most + 3):
        middle = len(template) // 2
        text = [f"w{rng.randrange(99)}" for _ in range(20)] + template[:middle] + ["word"] * other + template[middle:] + ["end"]
        got = [r for r in licenses.scan(text, SPLIT, VOCABULARY) if r[0] == name]
        assert [r[1:] for r in got] == ([(1.0, 20, 20 + len(template) + other)] if other <= most else []), other


def test_places_are_found_in_the_middle_of_prose_and_next_to_each_other():
    text = ("All plans were reserved. " * 3 + "Released under the MIT License. All rights reserved. " * 2
            + "It was released, under protest, to all. " * 3)
    assert [(r[0], r[1]) for r in scan(text)] == [("mit-line", 1.0), ("all-rights-reserved", 1.0)] * 2


def plain_places(words, template):
    """Whether any window of the words holds a place, by aligning every window."""
    m = len(template)
    need = -(-int(round(licenses.COVERAGE * m * 1000)) // 1000)
    foreign = int(licenses.FOREIGN * m)
    for a in range(len(words)):
        for b in range(a + need, min(len(words), a + m + foreign) + 1):
            pairs = licenses.align(words[a:b], template)
            if len(pairs) >= need and (b - a) - len(pairs) <= foreign:
                return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_scan_agrees_with_all_windows(seed):
    rng = random.Random(seed)
    short = {k: v for k, v in SPLIT.items() if len(v) < 13}
    for _ in range(60):
        name = rng.choice(sorted(short))
        words = [w for w in short[name] if rng.random() > 0.12]
        for _ in range(rng.randrange(7)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["alpha", "beta", *short[name]]))
        words = [w if w.isalpha() else f"x{w.translate(str.maketrans('0123456789', 'abcdefghij'))}" for w in words]
        template = [w if w.isalpha() else f"x{w.translate(str.maketrans('0123456789', 'abcdefghij'))}" for w in short[name]]
        got = licenses.scan(words, {name: template}, set(template))
        if got:
            assert plain_places(words, template)
        elif plain_places(words, template):
            # anchors are words unique to a window, so other windows may align more
            assert max(words.count(w) for w in template) > 1


def test_the_lines_of_documents_are_found_where_they_stand():
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    short = {k: " ".join(v) for k, v in SPLIT.items()}
    for (text,) in rows:
        words = licenses.words_of(text)
        whole = f" {' '.join(words)} "
        got = licenses.scan(words, SPLIT, VOCABULARY)
        for name, line in short.items():
            assert sum(r[0] == name for r in got) == whole.count(f" {line} "), name


def test_cost_grows_with_the_text():
    rng = random.Random(3)
    words = sorted(VOCABULARY)
    took = []
    for n in (20_000, 80_000):
        text = [rng.choice(words) for _ in range(n)]
        start = time.perf_counter()
        licenses.scan(text, SPLIT, VOCABULARY)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0]       # linear is 4, quadratic 16
