"""Rendering of small pages."""

from __future__ import annotations

import time

import pytest

from twinpath.llm import html_text, queries


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<table><tr><th>h<th>wide head<tr><td>1<td>2<br>3</table>after", "h | wide head\n1 | 2\n  | 3\n\nafter"),
        ("<table><tr><td>x</td><td><table><tr><td>in</td></tr></table></td></tr></table>", "x | in"),
        ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
        ("<p hidden>a</p><span style='display: none'>b</span><div aria-hidden=true>c</div>d", "c\nd"),
        ("<script>if (a < b) {}</script><style>p{}</style>x<!-- y -->z", "xz"),
        ("<title>t</title><body>x", "x"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<b>bold <i>both</b> rest</i>", "bold both rest"),
        ("</div></p>x", "x"),
        ("<dl><dt>term<dd>what it is</dl>", "term\n  what it is"),
        ('<img alt="a cat"> <input type=submit value=Go><input type=hidden value=no>', "a cat Go"),
        ("<td>lonely</td>", "lonely"),
        ("<li>item", "- item"),
        ("a  b\n\tc", "a b c"),
        ("<script>never closed", ""),
        ("<textarea>&lt;kept&gt;</textarea>", "<kept>"),
    ],
)
def test_rendering(source, text):
    assert html_text.extracted(source)[1] == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math> b", "a x=1 b"),
        ("<svg><defs/><title>t</title><desc>d</desc><path d=''/><text x=1>one</text><text>two</text></svg>after", "one two after"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("size <select><option>a<option selected>b<option>c</select> now", "size b now"),
        ("<select><option disabled>pick<optgroup><option>x</optgroup></select>", "x"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<desc>shown</desc> outside", "shown outside"),
    ],
)
def test_formulas_drawings_dialogs_and_lists(source, text):
    assert html_text.extracted(source)[1] == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<span style='visibility:hidden'>a<b style='visibility: visible'>b</b></span>c", "bc"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
        ("<style>.x, #y {display:none} p.z {visibility: hidden}</style><p class='w x'>a<p id=y>b<p class=z>c<div class=z>d</div>", "d"),
        ("<style>.x{display:none} p.x{display:block}</style><p class=x>a<div class=x>b</div>", "a"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a<p>b", "b"),
        ("<style>@media print{.x{display:none}} @media screen{.y{display:none}} /* .z{display:none} */ .z{color:red}</style><p class=x>a<p class=y>b<p class=z>c", "a\n\nc"),
        ("<style media=print>.x{display:none}</style><style>p .x{display:none} .x:hover{display:none}</style><p class=x>a", "a"),
        ("<p class=x>a<style>.x{display:none", ""),
        ("<p class=x>a<style>.x{display:none}</style><p>b", "b"),
        ("<style>.h{display:block}</style><p hidden class=h>a<p hidden>b", "a"),
        ("<a title=it's>x</a> <a title='it\"s' href=/a/b/>y</a> <b x=\"a>b\" \"c>z</b>", "x y z"),
        ("<a =x ==y z = 'q' w>v</a><p a=>u", "v\n\nu"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g<td>h</table>", "a | b | c\nd |   | e\nf | g | h"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<table><tr><td colspan=100000>a<td>b<tr><td>c</table>", "a | b\nc"),
        ("<table><tr style='visibility:collapse'><td>a<tr><td>b</table>", "b"),
    ],
)
def test_style_rules_attributes_and_spans(source, text):
    assert html_text.extracted(source)[1] == text


@pytest.mark.parametrize(
    "source",
    [
        "<p><button>" + "<div>" * 40_000,
        "<p>" + "<button><div>" * 20_000,
        "<table><tr>" + "<td colspan=1000>x" * 10_000,
        "<table><tr>" + "<td rowspan=9999>x" * 3_000 + "<tr><td>y" * 3_000,
        "<table><tr><td>" + "w" * 100_000 + "<tr><td>a<td>b" * 10_000,
        "<table><tr>" + "<td>x" * 2_000 + "<td>" + "<br>y" * 20_000,
        "<a b='" * 20_000,
        '<a b="x' * 20_001,
        "<style>" + ".a{display:none}" * 20_000 + "</style>" + "<p class=b>x" * 2_000,
    ],
)
def test_cost_grows_with_the_source(source):
    began = time.process_time()
    text = html_text.extracted(source)[1]
    assert time.process_time() - began < 3 and len(text) < 20 * len(source) + 1000


def test_deep_nesting_and_long_sources_end():
    assert html_text.extracted("<div>" * 20_000 + "x")[1] == "x"
    assert html_text.extracted("<b" * 20_000)[1].startswith("<b<b")
    assert len(html_text.extracted("<table>" + "<tr><td>a<td>b" * 2000)[1].split("\n")) == 2000


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "<title>a  b</title><p>x", 3)], "page_id long, html string, text int")
    found = sorted((str(r["page_id"]), r["title"], r["text"]) for r in html_text.extract(pages).collect())
    assert found == [("1", "", ""), ("2", "", ""), ("2", "", ""), ("None", "a b", "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query_keeps_every_visible_word(spark, tables):
    """All words outside scripts, styles, comments and the head, in order: a tag-stripping brute force."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    for r in queries.op3_html(spark, tables).collect():
        body = re.sub(r"(?is)<(head|script|style)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", " ", pages[r["page_id"]])
        words = html.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        found = [w for w in r["text"].split() if w not in ("-", "|")]
        assert "".join(found) == "".join(w for w in words if w not in ("-", "|"))
