"""Cheap tests that spare a regex its run over a text that cannot match.

``low`` is the lower-cased text with other scripts blanked out. A required word
is searched in it as a literal pattern, which skips ahead by the word's length.
"""

from __future__ import annotations

from collections.abc import Iterable

from runscope.catalogs import alternative_words, required_text, shared_stems
from runscope.functions.text import quote_regex, sql_text


def low_sql(text: str) -> str:
    """SQL for the text that guards look at."""
    return f"regexp_replace(lower({text}), '[^\\\\x00-\\\\x7f]+', ' ')"


def _has(low: str, word: str) -> str:
    return f"{low} RLIKE {sql_text(quote_regex(word))}"


class Guards:
    """Guards for a set of patterns: shared stems first, then each pattern's own word."""

    def __init__(self, patterns: Iterable[str]):
        self.stem_of = shared_stems(patterns)
        self.stems = list(dict.fromkeys(self.stem_of.values()))

    def flags_sql(self, low: str) -> str:
        """SQL array: which of the stems occur."""
        tests = ", ".join(_has(low, stem) for stem in self.stems)
        return f"array({tests})" if tests else "array(true)"

    def _choice_sql(self, low: str, flags: str, pattern: str) -> str:
        """SQL test for a pattern that needs one of several words; empty for patterns of other kinds."""
        words, others = alternative_words(pattern)
        if not words:
            return ""
        found = [f"{flags}[{self.stems.index(w)}]" if w in self.stems else _has(low, w) for w in words]
        return " AND ".join([f"({' OR '.join(found)})", *(_has(low, w) for w in others)])

    def sql(self, low: str, flags: str, pattern: str, value: str) -> str:
        """SQL for ``value``, null without a run of the regex where it cannot match."""
        stem, word = self.stem_of.get(pattern), required_text(pattern)
        if stem is None:
            test = self._choice_sql(low, flags, pattern) if word is None else _has(low, word)
            return f"if({test}, {value}, NULL)" if test else value
        test = f"{flags}[{self.stems.index(stem)}]"
        if word != stem:
            test += f" AND {_has(low, word)}"
        return f"if({test}, {value}, NULL)"
