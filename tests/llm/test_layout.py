import random
import re
import time

import pytest

from civigrade.llm import layout
from civigrade.llm.catalog import QUERIES

CASES = {
    "text of blocks": ("<h1>A</h1>b<div>c</div>d<p>e<p>f", "A\n\nb\nc\nd\n\ne\n\nf"),
    "inline and blanks": ("a <b>b  <i>c</i></b>\n d<span>e</span>", "a b c de"),
    "breaks": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "entities": ("&lt;a&gt; &amp; &eacute; &#x4e00;", "<a> & é 一"),
    "hidden": ("a<p hidden>b</p><p style='Display : None'>c</p><script>d('</p>')</script><style>e</style><template>f</template><!-- g --><title>h</title>", "a"),
    "visibility": ('<div style="visibility:hidden">x</div>y<input value=z>', "y"),
    "details": ("<details><summary>s</summary>inside</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    "head ends by content": ("<head><title>t</title><p>a</p>", "a"),
    "lists": ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  1. c\n  2. d\n- e"),
    "numbered from": ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
    "definitions": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    "preformatted": ("x<pre>  a\n    b  </pre>y", "x\n\n  a\n    b\n\ny"),
    "aligned": ("<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>", "name   n\nalpha  1\nb      22"),
    "row groups": ("<table><caption>t</caption><thead><tr><td>a<td>b</thead><tbody><tr><td>c<td>d</table>", "t\na  b\nc  d"),
    "spans": ("<table><tr><td colspan=2>ab<td>c<tr><td>a<td>b<td>c</table>", "ab    c\na  b  c"),
    "arranging table": ("<table><tr><td><p>one</p><p>two</p><td>three</table>", "one\n\ntwo\nthree"),
    "nested table": ("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>", "a\n\nb  c\nd"),
    "quoted end": ('<a title="x > y">t</a>', "t"),
    "unfinished": ("a < b <c", "a < b <c"),
    "stray end tags": ("</p>a</div>b</table>c", "abc"),
    "nothing": ("", ""),
    "null": (None, ""),
}


TABLES = {
    "rows spanned": ("<table><tr><td rowspan=2>a<td>1<tr><td>2</table>", "a  1\n   2"),
    "rest of the group": ("<table><tbody><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b  c\nd     e\nf  g"),
    "a long cell": (f"<table><tr><td>a<td>1<tr><td>{'x' * 60}<td>2<tr><td>b<td>3</table>", f"{'a':48}  1\n{'x' * 60}  2\n{'b':48}  3"),
    "two lines": ("<table><tr><td>a<br>b<td>1<tr><td>c<td>2<br>3</table>", "a  1\nb\nc  2\n   3"),
    "paragraph in a cell": ("<table><tr><td><p>a</p><td><div>1</div><tr><td>bb<td>2</table>", "a   1\nbb  2"),
    "both spans": ("<table><tr><td rowspan=2 colspan=2>ab<td>1<tr><td>2<tr><td>x<td>y<td>z</table>", "ab    1\n      2\nx  y  z"),
    "odd spans": ("<table><tr><td rowspan=x colspan=0>a<td rowspan=-1>b<tr><td>c</table>", "a  b\nc"),
    "row without text": ("<table><tr><td rowspan=3>a<td>1<tr><td><tr><td>2</table>", "a  1\n   2"),
    "no cells": ("<table><tr></table>x", "x"),
}


@pytest.mark.parametrize("name", TABLES)
def test_tables(name):
    source, text = TABLES[name]
    assert layout.rendered(source) == text


def test_random_tables_against_a_plain_grid():
    """A second renderer that fills a grid square by square."""
    chance = random.Random(4)
    for _ in range(300):
        height, width = chance.randrange(1, 6), chance.randrange(1, 6)
        free = {(r, c) for r in range(height) for c in range(width)}
        source, texts = "<table>", {}
        for r in range(height):
            source += "<tr>"
            for c in range(width):
                if (r, c) not in free:
                    continue
                across = next(n for n in range(chance.randrange(1, 4), 0, -1) if all((r, c + i) in free for i in range(n)))
                down = next(n for n in range(chance.randrange(1, 4), 0, -1) if all((r + j, c + i) in free for i in range(across) for j in range(n)))
                free -= {(r + j, c + i) for i in range(across) for j in range(down)}
                texts[r, c] = ("w" * chance.randrange(9) if across == 1 else "s" * across, across)
                source += f"<td colspan={across} rowspan={down}>{texts[r, c][0]}"
        columns = [max([len(t) for (_, c), (t, n) in texts.items() if c == column and n == 1], default=0) for column in range(width)]
        lines = []
        for r in range(height):
            line = [" "] * (sum(columns) + 2 * width + 20)
            for (own, c), (text, _) in texts.items():
                if own == r:
                    at = sum(columns[:c]) + 2 * c
                    line[at : at + len(text)] = text
            lines.append("".join(line).rstrip())
        assert layout.rendered(source + "</table>") == "\n".join(line for line in lines if line)


FOREIGN = {
    "closed icon": ('a<svg width="1" viewBox="0 0 1 1"/>b<p>c', "ab\n\nc"),
    "closed icons": ("a<svg/>b<math />c<svg><path d='M0'/></svg>d", "abcd"),
    "unclosed object": ("a<object data=x.pdf>b<p>c", "ab\n\nc"),
    "unclosed drawing": ("a<svg><path d=M0><p>b</p><div>c", "a\n\nb\n\nc"),
    "labels": ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><style/><text x=1>Norte</text><text>Sul <tspan>2</tspan></text></svg>", "Norte\nSul 2"),
    "formula": ("E <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> f", "E x=1 f"),
    "formula table": ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1\n2"),
    "html in drawing": ("<svg><foreignObject><p>a</p><p>b</p></foreignObject><text>c</text></svg>d", "a\n\nb\n\nc\nd"),
    "fallback": ("<object><param name=a value=b><p>old</p></object>new", "old\n\nnew"),
    "unquoted slash": ("<svg href=a/><text>b</text></svg>c", "b\nc"),
    "names outside": ("<desc>a</desc> <metadata>b</metadata>", "a b"),
    "raw text": ("a<iframe>x</iframe><noscript>y</noscript>b", "ab"),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_drawings_formulas_and_objects(name):
    source, text = FOREIGN[name]
    assert layout.rendered(source) == text


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    source, text = CASES[name]
    assert layout.rendered(source) == text


@pytest.mark.parametrize("source", ["<a " * 200_000, "<" * 300_000, "<div>" * 30_000 + "x", "<ul><li>" * 3_000 + "x", "<table><tr><td>" * 2_000 + "x", '<a "' * 100_000 + ">", "a" * 2_000_000, "<!--" * 100_000])
def test_hostile_pages_end(source):
    start = time.perf_counter()
    layout.rendered(source)
    assert time.perf_counter() - start < 20


def test_no_visible_word_is_lost(spark):
    """Every word between the tags of the body, but for scripts, is in the text, in order."""
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op9_layout_text"](spark, folder).collect()
    assert len(rows) == len(pages)
    import html

    for row in rows:
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", pages[row.page_id])
        words = html.unescape(re.sub(r"<(?:br|/?(?:p|div|li|ul|h1|nav|article|footer|body|html))\b[^>]*>", " ", re.sub(r"</?(?:a|b)\b[^>]*>", "", body)).replace("<!DOCTYPE html>", "")).split()
        assert [w for w in row.text.split() if w != "-"] == [w for w in words if w != "-"]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (2, "<p>a", None), (2, "<p>a", None)], "page_id long, html string, text string")
    rows = layout.with_text(pages, ["page_id"]).collect()
    assert sorted(((r.page_id, r.text) for r in rows), key=repr) == sorted([(1, ""), (None, ""), (2, "a"), (2, "a")], key=repr)
    assert layout.with_text(pages.filter("page_id > 5"), ["page_id"]).count() == 0
