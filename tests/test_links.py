import pytest
from pyspark.sql import functions as F

from civigrade.sources import links

CASES = [
    ('<a href="a&#47;b.csv">x</a>', ["a/b.csv"]),
    ("<a href=f&eacute;.csv>", ["fé.csv"]),
    ("<a href='x&#x2F;y&#0;z&#128;&#xD800;.csv'>", ["x/y�z€�.csv"]),
    ('<a href="1.csv"><script>var x = \'<a href="no.csv">\'', ["1.csv"]),
    ("<a href=1.csv><!-- <a href=no.csv> <a href=no.csv>", ["1.csv"]),
    ("<!--> <a href=1.csv><!-- x --!><a href=2.csv>", ["1.csv", "2.csv"]),
    ("<textarea><a href=no.csv></textarea ><a href=1.csv><style><a href=no></style><TITLE><a href=no></tItLe><a href=2.csv>", ["1.csv", "2.csv"]),
    ("""<a title="x > y" data-href="no" HREF = 'b&amp;c.csv' href=second>""", ["b&c.csv"]),
    ('<a href="q?a=1&copy=2&lt=3&amp;b&copy;">', ["q?a=1&copy=2&lt=3&b©"]),
    ('<img alt="<a href=no.csv>"><a/href=1.csv><abbr href=no><area href=no>', ["1.csv"]),
    ("<a title=it's href=1.csv><a class href=2.csv><a href=3.csv", ["1.csv", "2.csv"]),
    ("<a name=x><a href=' \n1.csv\t'><scripts><a href=2.csv></scripts>", ["1.csv", "2.csv"]),
    ("<a href=a&unknown;b&notit;c&>", ["a&unknown;b&notit;c&"]),
    ("<!doctype html><?x <a href=no.csv ?><a href=1.csv>", ["1.csv"]),
    ("plain < a href=x> text <3 <a>", []),
    ("", []),
]


def test_lexer(spark):
    rows = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)] + [(99, None)], "i int, html string")
    found = {r.i: r.h for r in rows.select("i", links.hrefs(F.col("html")).alias("h")).collect()}
    assert found.pop(99) is None
    assert [found[i] for i in range(len(CASES))] == [expected for _, expected in CASES]


def test_long_pages_need_no_deep_stack(spark):
    """Half a million characters in one comment, one attribute, one script and one unclosed quote."""
    filler = "word \"quoted\" 'and' <b> = & " * 20_000
    for html, count in ((f"<!--{filler}--><a href=1>", 1), (f"<a title='{filler.replace(chr(39), '')}' href=1>", 1), (f"<script>{filler}</script><a href=1>", 1), (f"<a href=1>{filler}<a href=2>", 2)):
        assert len(spark.createDataFrame([(html,)], "h string").select(links.hrefs(F.col("h"))).first()[0]) == count


@pytest.mark.parametrize("name", ["&eacute;", "&Eacute;", "&NotEqualTilde;", "&amp", "&AMP;", "&gg;"])
def test_named_references(spark, name):
    import html

    assert spark.createDataFrame([(name,)], "t string").select(links.unescaped(F.col("t"))).first()[0] == html.unescape(name)
