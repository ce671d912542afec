"""HTML to text (STR-6), as a chain of native expressions.

Every repeat is possessive and stops at the next opening bracket, so that a match neither recurses
nor scans to the end from each unclosed tag: the work is linear in the length of the page.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bind, clean

# Parts without readable text. Each keeps its own closing mark, and the
# leftmost one wins, so a comment may hold a script tag and the reverse.
HIDDEN = (
    "(?is)<!--.*?(?:-->|\\z)"
    "|<script\\b[^<>]*+>.*?(?:</script\\s*+>|\\z)"
    "|<style\\b[^<>]*+>.*?(?:</style\\s*+>|\\z)"
)
TITLE = "(?is)<title\\b[^<>]*+>[^<]*+</title\\s*+>"
# The rest of a tag; a quoted attribute may hold ">".
REST = "[^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+>"
# Tags that sit inside a word or sentence and leave no space behind.
INLINE = (
    "(?i)</?(?:a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)\\b" + REST
)
TAG = "<[a-zA-Z/!?]" + REST
# Fixed value: a named, decimal or hexadecimal character reference.
REFERENCE = "&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);"
# Fixed value: white space that is not one single space already.
SPACES = "[\\s\u00a0&&[^ ]][\\s\u00a0]*+| [\\s\u00a0]++"
#: Every name with its text, as the standard library has them.
_NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})


def _reference(mark: Column) -> Column:
    """The text a reference stands for; an unknown name stays as it is."""
    name = F.substring(mark, 2, 1_000_000)
    name = F.rtrim(name, F.lit(";"))
    hexadecimal = F.lower(F.substring(mark, 3, 1)) == "x"
    digits = F.ltrim(F.regexp_extract(mark, "([0-9a-fA-F]+);", 1), F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    code = F.when(F.length(digits) > 7, F.lit(-1)).otherwise(
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    ).cast("bigint")
    bad = code.isNull() | (code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    named = F.coalesce(F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name), mark)
    return F.when(F.startswith(mark, F.lit("&#")), char).otherwise(named)


def _decode(c: Column) -> Column:
    between = F.split(c, REFERENCE, -1)
    marks = F.regexp_extract_all(c, F.lit(f"({REFERENCE})"), F.lit(1))
    joined = F.array_join(
        F.zip_with(between, marks, lambda text, mark: F.concat(text, F.coalesce(_reference(mark), F.lit("")))),
        "",
    )
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def _without_tags(c: Column) -> Column:
    text = F.regexp_replace(c, HIDDEN, " ")
    text = F.regexp_replace(text, TITLE, " ")
    text = F.regexp_replace(text, INLINE, "")
    text = F.regexp_replace(text, TAG, " ")
    return F.when(F.contains(c, F.lit("<")), text).otherwise(c)


def html_to_text(c: Column | str) -> Column:
    """Readable text of an HTML page or fragment; plain text passes through, without a look for tags where no bracket is."""
    return clean(F.regexp_replace(bind(bind(as_column(c), _without_tags), _decode), SPACES, " "))
