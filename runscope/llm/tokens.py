"""Token ids of whole texts, with words that come again taken from a memo.

A pre-tokenizer that never joins characters across a space lets a text be cut
there; equal parts have equal ids. Tokenizers of other kinds, and texts with
runs of white space, are encoded whole, so ids always equal the library's.
``encoder`` takes a text, ``batch_encoder`` an Arrow array of texts, in which
equal parts are looked up once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PARTS = 800_000        # parts a worker remembers; then it forgets all and starts again
LONGEST_PART = 64      # longer parts are encoded each time
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# A word of plain Latin letters, perhaps with marks behind it: one or two runs for both pre-tokenizers.
_WORD_AND_MARKS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")
_MARKS = ".,;:!?#$%&*|"
_RUNS = re.compile(r"\s\s")
_PLAIN_RUNS = ("  ", "\n\n", " \n", "\n ")
_OTHER_SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n"]


def has_runs(text: str) -> bool:
    """True if two characters of white space follow each other; mostly without a look at every character."""
    if any(space in text for space in _OTHER_SPACES):
        return _RUNS.search(text) is not None
    return any(run in text for run in _PLAIN_RUNS)


def _kind(config: dict) -> str:
    """How texts may be cut: ``space`` keeps the space with the word, ``drop`` loses it."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]):
        return "whole"
    pre = config["pre_tokenizer"] or {}
    if (config["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"]
            and not pre["add_prefix_space"]):
        return "space"
    steps = pre.get("pretokenizers") or [{}]
    first = steps[0]
    if (first.get("type") == "Split" and first["pattern"] == {"Regex": _WORD_PATTERN}
            and first["behavior"] == "Removed" and first["invert"]
            and all(s.get("type") == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"]
                    for s in steps[1:])):
        names = {s["type"] for s in (config["normalizer"] or {}).get("normalizers", [])}
        if names <= {"NFC", "Replace", "Lowercase"}:
            return "drop"
    return "whole"


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level tokenizers name bytes: visible ones stand for themselves."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """Ids of parts; ``word`` encodes plain words, ``encode`` everything else."""

    def __init__(self, encode: Callable[[str], bytes], word: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.word = encode, word

    def __missing__(self, part: str) -> bytes:
        body = part[1:] if part[:1] == " " else part
        if body.isascii() and body.isalpha():
            ids = self.word(part)
        elif found := _WORD_AND_MARKS.fullmatch(part):
            if not found[2]:
                ids = self.word(part)
            elif found[1] in self:
                ids = self[found[1]] + self[found[2]]
            else:                           # a rare word is remembered by itself only
                return self[found[1]] + self[found[2]]
        else:
            ids = self.encode(part) if part else b""
        if len(part) <= LONGEST_PART:
            self[part] = ids
        return ids


class _Opened(NamedTuple):
    """A tokenizer, how texts may be cut, and functions to the ids of any text and of a word, perhaps behind a space."""

    tokenizer: object
    kind: str
    whole: Callable[[str], bytes]
    word: Callable[[str], bytes]


def _opened(path: str) -> _Opened:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = _kind(json.loads(tokenizer.to_str()))

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    names, model = _byte_characters(), tokenizer.model
    blank = names[ord(" ")]

    def word(part: str) -> bytes:
        """A word is a run of its own and in normal form but for case, so the model alone gives its ids."""
        if kind == "drop":
            part = part.lower()
        if part.isascii():                  # letters stand for themselves
            shown = blank + part[1:] if part[0] == " " else part
        else:
            shown = part.encode().decode("latin-1").translate(names)
        return array("I", [token.id for token in model.tokenize(shown)]).tobytes()

    return _Opened(tokenizer, kind, whole, word)


_ENCODERS: dict[str, Callable[[str | None], bytes]] = {}


def encoder(path: str) -> Callable[[str | None], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit integers (null: none)."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    _, kind, whole, word = _opened(path)
    memo = _Memo(whole, word)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if len(memo) > PARTS:
            memo.clear()
        if kind == "drop":
            if text.isascii() and "<|" not in text:     # the tokenizer lowers letters; marks of special tokens stay
                text = text.lower()
            return b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" ")))
        if kind == "space" and "\0" not in text and not has_runs(text):
            parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
            return b"".join(map(memo.__getitem__, parts))
        return whole(text)

    _ENCODERS[path] = encode
    return encode


# ---- many texts at once --------------------------------------------------------

_BLANK, _NEWLINE, _LETTER, _MARK, _ACCENT, _ACCENTED, _SPACE_START = 1, 2, 4, 8, 16, 32, 64
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
WORDS_A_CALL = 256


def _byte_classes(marks: str) -> np.ndarray:
    """Flags of the 256 bytes; ``_ACCENT`` and ``_ACCENTED`` are the two bytes of letters from À to ÿ."""
    classes = np.zeros(256, np.uint8)
    for flag, members in (
            (_BLANK, b" \n"), (_NEWLINE, b"\n"), (_LETTER, [*range(65, 91), *range(97, 123)]), (_MARK, marks.encode()),
            (_ACCENT, b"\xc3"), (_ACCENTED, set(range(0x80, 0xC0)) - {0x97, 0xB7}),
            (_SPACE_START, {c.encode()[0] for c in _OTHER_SPACES})):
        classes[list(members)] |= flag
    return classes


def _cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where parts of texts start in their bytes, for the kind ``space``; a text with runs of white space is one part.

    Besides blanks, texts are cut between a Latin letter and one of the marks,
    where every run of the pre-tokenizer ends.
    """
    flags = classes[data]
    cut = flags & _BLANK != 0
    pairs = cut[1:] & cut[:-1]
    pairs[starts[(starts > 0) & (starts < len(data))] - 1] = False      # the end of one text and the start of the next
    cut[1:] |= flags[:-1] & _NEWLINE != 0
    letter = flags & _LETTER != 0
    letter[1:] |= (flags[:-1] & _ACCENT != 0) & (flags[1:] & _ACCENTED != 0)
    cut[1:] |= letter[:-1] & (flags[1:] & _MARK != 0)
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(pairs), "right") - 1] = True
    unsure = np.zeros(len(starts), bool)            # these may hold white space of other kinds
    unsure[np.searchsorted(starts, np.flatnonzero(flags & _SPACE_START), "right") - 1] = True
    for k in np.flatnonzero(unsure & ~whole):
        whole[k] = has_runs(data[starts[k]:ends[k]].tobytes().decode())
    for k in np.flatnonzero(whole):
        cut[starts[k]:ends[k]] = False
    cut[starts[starts < ends]] = True
    return np.flatnonzero(cut)


class _Recent:
    """Ids of parts met lately; those used again outlive ``PARTS`` others."""

    def __init__(self, find: Callable[[list[bytes]], list[bytes]]) -> None:
        self.find = find
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.new) > PARTS // 2:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, parts))
        other = [k for k, ids in enumerate(found) if ids is None]
        for k in other:
            found[k] = self.old.get(parts[k])
        fresh = [k for k in other if found[k] is None]
        for k, ids in zip(fresh, self.find([parts[k] for k in fresh])):
            found[k] = ids
        self.new.update((parts[k], found[k]) for k in other if len(parts[k]) <= LONGEST_PART)
        return found


def _lone_byte(model: dict, names: dict[int, str]) -> int | None:
    """A byte that no merge of the model takes, so that words joined by it keep their ids; none for models of other kinds."""
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    if model.get("type") != "BPE" or any(model.get(k) for k in (*plain, "ignore_merges", "byte_fallback", "fuse_unk")):
        return None
    merged = set().union(*("".join(m) for m in model["merges"]))
    return next((b for b in range(32) if chr(b) not in "\t\n" and names[b] not in merged and names[b] in model["vocab"]), None)


_BATCH_ENCODERS: dict[str, Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]] = {}


def batch_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from an array of texts to the ids of all, one text behind the other, and the count of each (null: none).

    Ids equal those of ``encoder``. Texts are cut in their bytes, each distinct
    part of the array is looked up once, and new words go to the tokenizer's
    model many at a time.
    """
    if path in _BATCH_ENCODERS:
        return _BATCH_ENCODERS[path]
    opened = _opened(path)
    config, names, model = json.loads(opened.tokenizer.to_str()), _byte_characters(), opened.tokenizer.model
    lone = _lone_byte(config["model"], names)
    classes = _byte_classes("".join(m for m in _MARKS if not any(m in t["content"] for t in config["added_tokens"])))

    def find(parts: list[bytes]) -> list[bytes]:
        is_word = [lone is not None and _WORD.fullmatch(part) is not None for part in parts]
        words = [part for part, yes in zip(parts, is_word) if yes]
        found: list[bytes] = []
        for at in range(0, len(words), WORDS_A_CALL):
            joined = bytes([lone]).join(words[at:at + WORDS_A_CALL]).decode("latin-1").translate(names)
            ids = np.array([token.id for token in model.tokenize(joined)], "<u4")
            ends = 4 * np.flatnonzero(ids == model.token_to_id(names[lone]))
            raw = ids.tobytes()
            found += [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]
        each = iter(found)
        return [next(each) if yes else opened.whole(part.decode()) for part, yes in zip(parts, is_word)]

    recent = _Recent(find)

    def one_by_one(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(encoder(path), texts.to_pylist()))
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)

    def in_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        if at[0] == at[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, at[-1] - at[0], at[0])
        at = at - at[0]
        cuts = _cuts(data, at[:-1], at[1:], classes)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts), [
            None, pa.py_buffer(np.append(cuts, len(data)).astype("<i8")), pa.py_buffer(data)]).dictionary_encode()
        distinct = parts.dictionary
        places = np.frombuffer(distinct.buffers()[1], "<i8", len(distinct) + 1).tolist()
        raw = distinct.buffers()[2].to_pybytes()
        found = recent.ids([raw[a:b] for a, b in zip(places, places[1:])])
        ids = pa.array(found, pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[np.searchsorted(cuts, at)] // 4
        return np.frombuffer(ids.buffers()[2], "<u4", ends[-1]), np.diff(ends)

    _BATCH_ENCODERS[path] = in_parts if opened.kind == "space" else one_by_one
    return _BATCH_ENCODERS[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
