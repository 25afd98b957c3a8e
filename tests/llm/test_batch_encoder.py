"""Ids of many texts at once: the tokenizer's own ids, and little asked twice."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runscope.llm import token_files, tokens

ODD = [
    None, "", " ", "\n", "a", "It's don't. we'll, I'd!", "end.\nnext word\nthe end\n", " two  blanks", "tab\there", "a\t b",
    "line\n\nline", "line\n line", "line \nline", "non breaking", "non  breaking", "　wide", "wide 　 space",
    "  ", "nul\0byte \0 x", "<|endoftext|>", "x<|endoftext|>y. z", "word| |x |", "été, Ñandú! ÷× ä÷. ö×,", "日本語 です。 、x",
    "Ωmega. ж, е!", "12,000.50 $5 #a a#b a.b.c a...b", "é. café,", "\x1c\x1d a", "x" * 100 + ". " + "y" * 70, "ﬁ. ª, º! ĳ?",
    "Ã© â€™s.", "🙂. a🙂, b", "a_b, _c. 'tis 's's.s", "last ", "café", " naïve.",
]


def texts(seed):
    pick = random.Random(seed)
    pieces = [t for t in ODD if t] + ["the", "of", " and ", ". ", ",", "\n", " ", "é", "ß", "%%%", "|", "'s", "7"]
    return ["".join(pick.choices(pieces, k=pick.randrange(12))) for _ in range(300)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_many_texts_are_those_of_the_tokenizer(name, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 40)          # so that parts are forgotten between arrays
    monkeypatch.setattr(tokens, "WORDS_A_CALL", 3)
    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), tokens.batch_encoder(path)
    for kind in (pa.string(), pa.large_string()):
        for rows in (ODD, texts(1), texts(2), texts(1), [None, None], [""], []):
            ids, counts = encode(pa.array(["before it", None, *rows, "behind"], kind).slice(2, len(rows)))
            expected = [whole.encode(t or "", add_special_tokens=False).ids for t in rows]
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][:len(rows)] == expected
            assert len(counts) == len(rows)


def test_new_words_are_looked_up_once_and_words_in_use_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 100)
    asked = []

    def find(parts):
        asked.extend(parts)
        return [b"1234" * len(p) for p in parts]

    recent = tokens._Recent(find)
    for k in range(200):
        parts = [b" the", b" of", *(b" rare%d" % (10 * k + i) for i in range(10))]
        assert recent.ids(parts) == [b"1234" * len(p) for p in parts]
        assert len(recent.new) + len(recent.old) < 200
    assert asked.count(b" the") == asked.count(b" of") == 1
    assert len(asked) == 2002


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(
        ["aaaa", None, "bbbbbb", "c", "d" * 50, "", "e" * 10, "é" * 5, ""])], ["doc_id", "text"])
    got = [s.column(0).to_pylist() for s in token_files.slices(batch)]
    assert got == [[0, 1, 2], [3], [4], [5, 6], [7, 8]]
    assert list(token_files.slices(batch.slice(0, 0))) == []


def test_words_are_joined_only_by_a_byte_that_no_merge_takes():
    names = tokens._byte_characters()
    model = {"type": "BPE", "vocab": {names[b]: b for b in range(5)}, "merges": [[names[0], "a"], ["b", names[1] + "c"]]}
    assert tokens._lone_byte(model, names) == 2
    assert tokens._lone_byte(model | {"end_of_word_suffix": "</w>"}, names) is None
    assert tokens._lone_byte(model | {"type": "Unigram"}, names) is None
