"""Text helpers as Column functions; none of them needs a Python UDF."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "... (truncated)"

# White space of any script, as a regex class body, and words between it.
SPACE = r"\s\x1c-\x1f"
WORD = rf"(?U)[^{SPACE}]+"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def sql_text(text: str) -> str:
    """A SQL string literal. Long generated expressions parse much faster as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    """Remove white space of any kind at both ends; looks at the ends only."""
    return f"btrim({text}, {sql_text(SPACE_CHARACTERS)})"


def newlines_sql(text: str) -> str:
    return rf"(length({text}) - length(replace({text}, '\n', '')))"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def quote_regex(text: str) -> str:
    """A pattern that matches ``text`` literally, in any regex dialect."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def token_estimate(text: Column) -> Column:
    """Words times 1.3."""
    return word_count(text) * F.lit(1.3)


def truncate_tokens(text: Column, limit: int) -> Column:
    """Keep the first ``int(limit / 1.3)`` words when the text holds more.

    Words are then joined by one blank and a marker is added; the marker is
    not counted against the limit.
    """
    keep = int(limit / 1.3)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    marker = f"\n\n... (Content truncated to stay within {limit} token limit)"
    cut = let(words, lambda w: F.concat(F.array_join(F.slice(w, 1, max(keep, 0)), " "), F.lit(marker)))
    return F.when(word_count(text) > keep, cut).otherwise(text)


def limit_tokens(text: Column, limit: int) -> Column:
    """Truncate only a text whose estimate is above the limit."""
    return F.when(token_estimate(text) > limit, truncate_tokens(text, limit)).otherwise(text)


def excerpt(text: Column, chars: int) -> Column:
    """First ``chars`` characters, with a marker line when something was cut."""
    cut = F.concat(F.substring(text, 1, chars), F.lit("\n" + TRUNCATED))
    return F.when(F.length(text) > chars, cut).otherwise(text)


def quoted_list(items: Column) -> Column:
    """``['a', 'b']`` for an array of strings."""
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
