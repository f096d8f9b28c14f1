from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanmill.functions import patterns
from scanmill.functions.text import (
    decode_utf8,
    get_analyzer,
    html_to_text,
    read_stop_words,
    strip_http_headers,
    word_tokens,
)

SENTENCE = (
    "The U.S. Dept. of Justice has announced that Panasonic and its subsidiary Sanyo have been "
    "fined $56.5 million for their roles in price fixing conspiracies involving battery cells "
    "and car parts."
)


def one(spark, value, column, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("name, count", [("standard", 23), ("porter", 19)])
def test_sentence_token_counts(spark, name, count):
    assert len(one(spark, SENTENCE, get_analyzer(name).tokens("t"))) == count


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("1,000 and 3.14", ["1,000", "and", "3.14"]),
        ("can't O’Neil a.m. x.", ["can't", "o’neil", "a.m", "x"]),
        ("_foo_ bar__baz ___", ["_foo_", "bar__baz"]),
        ("foo:bar a.1 1.a b,c", ["foo:bar", "a", "1", "1", "a", "b", "c"]),
        ("日本 ひら カタカナ", ["日", "本", "ひ", "ら", "カタカナ"]),
        ("ÉCOLE straße éte", ["école", "straße", "éte"]),
        ("a/b-c a+b <x>", ["a", "b", "c", "a", "b", "x"]),
        ("", []),
    ],
)
def test_word_rules(spark, text, tokens):
    assert one(spark, text, word_tokens("t")) == tokens


def test_very_long_tokens_do_not_overflow_the_stack(spark):
    text = "a1" * 400_000 + " " + "_" * 300_000 + " " + "x.y" * 200_000
    sizes = one(spark, text, F.transform(word_tokens("t"), F.length))
    assert sizes == [800_000, 600_000]
    assert one(spark, text, get_analyzer("standard").tokens("t")) == []


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1é.,:;'_- \n<日アñΣ́·²", max_size=40), min_size=50, max_size=50))
def test_shortcut_changes_nothing(spark, texts):
    full = F.regexp_extract_all(F.lower("t"), F.lit(patterns.token_pattern(shortcut=False)), F.lit(0))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~word_tokens("t").eqNullSafe(full)).count() == 0


def test_both_dialects_agree(spark):
    import duckdb

    texts = [SENTENCE, "foo:bar a.1 b__c _d", "l'été 1,5 _ x", "日本 カタ"]
    theirs = [
        duckdb.execute(
            "SELECT regexp_extract_all(lower(?), ?, 0)", [t, patterns.token_pattern("re2")]
        ).fetchone()[0]
        for t in texts
    ]
    assert [one(spark, t, word_tokens("t")) for t in texts] == theirs


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><p>b</p>", "a b"),
        ("<b>foo</b>bar<i>baz</i>", "foobarbaz"),
        ("x<br>y<BR/>z", "x y z"),
        ("a<!-- b <p> -->c", "ac"),
        ("a<script>if (1<2) x('</p>')</script>b", "a b"),
        ("a<style>p{}</style >b <script src=x", "a b"),
        ("<a title=\"x>y\" href='>'>k</a>", "k"),
        ("<p class=it's>ok", "ok"),
        ("1 < 2 &amp; 3 &gt; 2 &eacute;&#233;&#xe9; &amp;lt;", "1 < 2 & 3 > 2 ééé &lt;"),
        ("<!DOCTYPE html><?xml?>  \n t ", "t"),
        ("a <unclosed attr", "a"),
        ("<p-x>a</p-x>b", "ab"),
        ("a<!-- never closed", "a"),
        # Comments that end early, late or never; bogus ones; declarations.
        ("a<!-->b", "ab"),
        ("a<!--->b", "ab"),
        ("a<!-- x --!>b", "ab"),
        ("a<!-- x -- > y -->b", "ab"),
        ("a</ x>b", "ab"),
        ("a</>b", "ab"),
        ("a</", "a</"),
        ("a<?php echo '>'; ?>b", "a'; ?>b"),
        ("a<![CDATA[ x > y ]]>b", "a y ]]>b"),
        ("<svg><![CDATA[ x > y &amp; ]]></svg>b", "x > y &amp; b"),
        ("<svg/><![CDATA[ x > y ]]>b", "y ]]>b"),
        ("<svg><p>a<![CDATA[ x > y ]]>", "a y ]]>"),
        # Attribute values.
        ("<a x='>' y = \">\" z=>k</a>", "k"),
        ("<a x=\"never closed>k</a>", ""),
        ("<img alt=a/b>k<br/>l", "k l"),
        ("<a ='x>y'>k", "y'>k"),
        ("<a / x = '/>'/>k", "k"),
        # Raw text and escapable raw text.
        ("<title>a<b>c</b>&amp;d</TITLE >e", "a<b>c</b>&d e"),
        ("<textarea><!-- x --></textarea>y", "<!-- x -->y"),
        ("<xmp>a<p>&amp;</xmp>b", "a<p>&amp;b"),
        ("a<title>no end", "a no end"),
        ("<plaintext>a<b>&lt;</plaintext>", "a<b>&lt;</plaintext>"),
        ("<style></styles>x</style>y", "y"),
        ("a<script><!-- <script> </script> --></script>b", "a b"),
        ("a<script><!-- </script>b", "a b"),
        ("a<script><!--><script></script>b", "a b"),
        ("a<script>no end <p>", "a"),
        # What only looks like markup.
        ("1<2 <3 a<1>b < i", "1<2 <3 a<1>b < i"),
        ("<é>x</é>", "<é>x"),
        ("&am<b>p;</b> &ampx &notit; &#x41 &#0;", "&amp; &x ¬it; A \ufffd"),
        ("<P\nCLASS=x>a<DIV\f>b", "a b"),
    ],
)
def test_html_to_text(spark, page, text):
    assert one(spark, page, html_to_text("t")) == text


def test_http_headers_by_version(spark):
    body = "HTTP/1.1 200 OK\r\nContent-Length: 9\r\nX: y\r\n\r\n<p>hi</p>"
    assert one(spark, body, strip_http_headers("t", "1.0")) == "<p>hi</p>"
    assert one(spark, body, strip_http_headers("t", "0.18")) == "X: y\r\n\r\n<p>hi</p>"
    assert one(spark, "Content-Length: 2\nplain", strip_http_headers("t", "1.0")) == "plain"
    assert one(spark, "no header line <b>", strip_http_headers("t", "1.0")) == "<b>"
    with pytest.raises(ValueError):
        strip_http_headers("t", "2.0")


def test_malformed_bytes_are_replaced(spark):
    assert one(spark, b"ok \xff\xfe", decode_utf8("t"), "t binary") == "ok ��"


def test_analyzers_by_name(spark, tmp_path):
    with pytest.raises(ValueError):
        get_analyzer("snowball")
    path = tmp_path / "stop.txt"
    path.write_text("Foo\n\n bar \n")
    words = read_stop_words(spark, str(path))
    custom = get_analyzer("porter", words)
    assert one(spark, "foo bars bar running", custom.tokens("t")) == ["bar", "run"]
    with pytest.raises(ValueError):
        read_stop_words(spark, str(path), limit=1)
    assert one(spark, "the cat", get_analyzer("standard", []).tokens("t")) == ["the", "cat"]
