import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsprep import functions as fn

NBSP, LQ, RQ, LD, RD = chr(0xA0), chr(0x2018), chr(0x2019), chr(0x201C), chr(0x201D)


@pytest.mark.parametrize("text, expected", [
    ("", ""), (" \t\n ", ""), ("\t\n" + NBSP + "a b" + NBSP, "a b"), ("a\nb", "a\nb"), (None, None),
])
def test_clean_strips_every_kind_of_space(one, text, expected):
    assert one(fn.clean, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("a\n\nb", "a b"), ("  a" + NBSP + NBSP + " b ", "a b"), ("\n", ""), (None, None),
])
def test_extra_whitespace(one, text, expected):
    assert one(fn.clean_extra_whitespace, text) == expected


def test_quotes_survive_as_ascii(one):
    text = f"{LD}caf{chr(0xE9)}{RD} {LQ}n{RQ} {chr(0x1F600)}!"
    assert one(fn.replace_quotes, text) == f"\"caf{chr(0xE9)}\" 'n' {chr(0x1F600)}!"
    assert one(fn.clean_question, text) == "\"caf\" 'n' !"
    assert one(fn.strip_non_ascii, text) == "caf n !"


def test_question_is_cut_after_cleaning(one):
    assert one(lambda c: fn.clean_question(c, 3), "  " + chr(0xE9) + "abcdef") == "abc"


@pytest.mark.parametrize("text, expected", [
    ("a\nb\n\nc", "a b\n\nc"), ("a \n b\n \t\nc\n\n\n\nd", "a b\n\nc\n\nd"), ("", ""), ("one", "one"), (None, None),
])
def test_paragraphs(one, text, expected):
    assert one(fn.group_paragraphs, text) == expected


def test_clean_fields_leaves_the_others(spark):
    row = fn.clean_fields(spark.createDataFrame([("a\nb", "c\nd")], "x string, y string"), ["x"]).first()
    assert (row["x"], row["y"]) == ("a b", "c\nd")


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=40), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_cleaning_twice_is_cleaning_once(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for f in (fn.clean, fn.clean_extra_whitespace, fn.strip_non_ascii, fn.replace_quotes, fn.clean_sample, fn.group_paragraphs):
        assert df.where(~f("x").eqNullSafe(f(f("x")))).count() == 0, f.__name__


@pytest.mark.parametrize("html, expected", [
    ("plain text", "plain text"),
    ("<p>a<p>b<div>c", "a b c"),
    ("<div><p>a <b>bo</b>ld</p></div>", "a bold"),
    ('x<a href="q>r">link</a> y', "xlink y"),
    ("x <img alt='a > b'>y", "x y"),
    ("a<script>if (1) { '</p>' }</script>b", "a b"),
    ("a<!-- <script> -->b", "a b"),
    ("a<script>x <!-- </script>b", "a b"),
    ("a<style>p{}</style>b<head><title>t</title></head>c", "a b c"),
    ("<title>t</title>body <!-- never closed", "body"),
    ("a<script>never closed", "a"),
    ("<header>kept</header>", "kept"),
    ("&amp;lt; &lt; &unknown; &copy;&nbsp;x", "&lt; < &unknown; " + chr(0xA9) + " x"),
    ("&#65;&#x42;&#8217;&#0;&#38;lt;&#38;amp;", "AB" + chr(8217) + chr(0xFFFD) + "&lt;&amp;"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("", ""), (None, None),
])
def test_html(one, html, expected):
    assert one(fn.html_to_text, html) == expected


def test_html_of_a_long_page(one):
    page = "<p class=\"a b\" id='c'>word</p>" * 20_000
    assert one(fn.html_to_text, page) == " ".join(["word"] * 20_000)


def test_a_tag_with_many_attributes(one):
    assert one(fn.html_to_text, "<p " + "a='b' " * 500_000 + ">x") == "x"


@pytest.mark.parametrize("part", ["<a b", "<script ", "<title>", "<p a='b' "])
def test_html_never_closed_is_linear(one, part):
    assert one(fn.html_to_text, part * 500_000) is not None


def test_html_references(one):
    assert one(fn.html_to_text, "It&rsquo;s 5&ndash;6 &euro; caf&eacute;&hellip; &#00000065;&#x41; &amp;lt; &nope; &#9999999999;") == (
        "It\u2019s 5\u20136 \u20ac caf\u00e9\u2026 AA &lt; &nope; \ufffd"
    )


@pytest.mark.parametrize("text, expected", [
    ("1/3/2024", "2024-03-01"), ("01/03/2024", "2024-03-01"), ("2024-03-01", None), ("31/02/2024", None), (None, None),
])
def test_parse_day(one, text, expected):
    day = one(fn.parse_day, text)
    assert (str(day) if day else None) == expected


def test_strict_day_raises(one):
    assert str(one(lambda c: fn.parse_day(c, strict=True), "1/3/2024")) == "2024-03-01"
    with pytest.raises(Exception, match="is not a day/month/year date"):
        one(lambda c: fn.parse_day(c, strict=True), "2024-03-01")


def test_stamps(one):
    parse = lambda c: fn.iso_z(fn.parse_rfc3339(c))
    assert one(parse, "2024-01-02T03:04:05Z") == "2024-01-02T03:04:05Z"
    assert one(parse, "2024-01-02T03:04:05.25+02:00") == "2024-01-02T01:04:05Z"
    assert [one(parse, x) for x in ("soon", "2024", "2024-01", "10:11", "2024-01-02")] == [None] * 5


def test_prompts(one):
    built = one(lambda c: fn.inference_text(c, F.lit("news"), F.lit("why?")), "me")
    assert built.startswith("[INST] ") and built.endswith("\n\n### QUESTION: why? [/INST]")
    assert "\n\n### ABOUT ME: me\n\n### LATEST NEWS: news\n\n" in built and "HISTORY" not in built
    with_history = one(lambda c: fn.inference_text(c, F.lit(""), F.lit("q"), F.lit("h")), None)
    assert "### ABOUT ME: \n" in with_history and "### CHAT HISTORY: h\n" in with_history
    trained = one(lambda c: fn.training_text(c, F.lit("n"), F.lit("q"), F.lit("a")), "me")
    assert trained.endswith(" [/INST]\n\n### RESPONSE: a </s>")
    teacher = one(lambda c: fn.teacher_text(c, F.lit("n")), "me")
    assert "\n\n# ABOUT ME\nme\n\n# CONTEXT\nn\n\n" in teacher


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(fn.cosine("a", "b")).collect()] == [0.707107, 0.0]


def test_hash_vector_counts_every_word(spark):
    df = spark.createDataFrame([("b a a",), ("",), (None,)], "x string")
    rows = [r[0] for r in df.select(fn.hash_vector("x", 16)).collect()]
    import hashlib

    slot = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in "ab"}
    assert [len(v) for v in rows] == [16, 16, 16] and [sum(v) for v in rows] == [3, 0, 0]
    assert rows[0][slot["a"]] >= 2 and rows[0][slot["b"]] >= 1


def test_count_tokens(spark):
    df = spark.createDataFrame([("a bb  ccc ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(fn.count_tokens("x")).collect()] == [3, 0, 0]
    make = lambda: lambda texts: [len(t) for t in texts]
    assert [r[0] for r in df.select(fn.count_tokens("x", make)).collect()] == [10, 0, 0]


def test_html_without_brackets_is_not_looked_through_for_tags(one, spark, plan):
    """Only the white space that changes is replaced, and the result is that of replacing all of it."""
    for text in ("a b", " a  b ", "a\u00a0b", "a \u00a0 b\t\nc", "x &lt;b&gt; y", "<p>a  b</p> c", "", " ", "a > b"):
        expected = re.sub("[ \t\n\u00a0]+", " ", text.replace("<p>", " ").replace("</p>", " ")).strip().replace("&lt;", "<").replace("&gt;", ">")
        assert one(fn.html_to_text, text) == expected
    assert one(fn.html_to_text, None) is None
    assert "CASE WHEN Contains(" in plan(spark.createDataFrame([("a",)], "x string").select(fn.html_to_text("x")))
