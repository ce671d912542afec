"""Text cleaning as column expressions (STR-1..5, STR-7..9)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that stripping removes, ASCII and Unicode.
WHITE = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85"
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Curly single and double quotes, and what replaces them.
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c`` with ``c`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def clean(c: Column | str) -> Column:
    """STR-1: strip white space at both ends."""
    return F.trim(as_column(c), F.lit(WHITE))


def clean_extra_whitespace(c: Column | str) -> Column:
    """STR-2: newline and non-breaking space become spaces, runs of spaces one, ends stripped."""
    spaced = F.translate(as_column(c), "\n\u00a0", "  ")
    return clean(F.regexp_replace(spaced, " {2,}", " "))


def strip_non_ascii(c: Column | str) -> Column:
    """STR-3: drop every character outside ASCII."""
    return F.regexp_replace(as_column(c), "[^\\x00-\\x7F]+", "")


def replace_quotes(c: Column | str) -> Column:
    """STR-4: curly quotes become straight ones."""
    straight = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    return F.translate(as_column(c), SINGLE_QUOTES + DOUBLE_QUOTES, straight)


def group_paragraphs(c: Column | str) -> Column:
    """STR-5: a lone newline becomes a space; blank lines stay as paragraph breaks."""
    paragraphs = F.split(clean(c), "\n[ \\t\\r\\f]*\n[ \\t\\r\\f\n]*")
    return F.array_join(
        F.transform(paragraphs, lambda p: F.regexp_replace(p, "[ \\t\\r\\f]*\n[ \\t\\r\\f]*", " ")),
        "\n\n",
    )


def clean_ascii(c: Column | str) -> Column:
    """STR-1, STR-4, STR-3: the chain used on articles and questions."""
    return strip_non_ascii(replace_quotes(clean(c)))


def clean_question(c: Column | str, max_chars: int | None = None) -> Column:
    """STR-7, then STR-8 when ``max_chars`` is given."""
    cleaned = clean_ascii(c)
    return cleaned if max_chars is None else cut(cleaned, max_chars)


def cut(c: Column | str, max_chars: int) -> Column:
    """STR-8: the first ``max_chars`` characters."""
    return F.substring(as_column(c), 1, max_chars)


def clean_sample(c: Column | str) -> Column:
    """STR-2, STR-5: the chain used on samples and prompt inputs."""
    return group_paragraphs(clean_extra_whitespace(c))


def clean_fields(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """STR-9: clean the named fields in one projection."""
    return df.withColumns({name: clean_sample(name) for name in cols})


def single_spaced(c: Column | str) -> Column:
    """The words of a text with one space between them."""
    spaced = F.translate(as_column(c), WHITE, " " * len(WHITE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def words(c: Column | str) -> Column:
    """The words of a text; empty text has none."""
    spaced = F.translate(as_column(c), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " +"), "")
