"""Trees of malformed markup, selectors, grids, sections, and the page operators on odd pages."""

import pytest
from pyspark.sql import functions as F

from interlace.functions import markup as M
from interlace.functions import text as X
from interlace.operators import pages as P


def test_elements_that_are_never_closed():
    root = M.tree("<ul><li>a<li>b <b>c<li>d</ul><p>e<p>f<div>g</p>h</div></i>i")
    assert [n.text() for n in root.select("li")] == ["a", "b c", "d"]
    assert root.text() == "a\nb c\nd\ne\nf\ngh\ni"


def test_tables_without_ends_nest():
    root = M.tree("<table><tr><td>1<td>2<tr><td>3<table><tr><td>in<tr><td>ner</table><td>4</table>after")
    assert [[c[0] for c in row] for row in M.grid(root.select("table")[0])] == [["1", "2"], ["3\nin\nner", "4"]]
    assert [[c[0] for c in row] for row in M.grid(root.select("table")[1])] == [["in"], ["ner"]]


@pytest.mark.parametrize("selector, want", [
    ("p", "2 3 5"), (".x", "1 5"), ("div.x", "1"), ("div > p", "2 5"), ("div p", "2 3 5"), ("p + i", "7"), ("i + b", "4"), ("p + b", ""), ("p ~ b", "4"), ("p, b", "2 3 4 5"), ("[data-k*='b c']", "5"), ("p[data-k^=a]", "5"), ("[data-k$=c]", "5"), ("[data-k=a]", ""), ("*.x > p", "2"), ("i p", "3"),
])
def test_selectors(selector, want):
    root = M.tree("<div class='x y' id=1><p id=2></p><i id=7><p id=3></p></i><b id=4></b></div><div id=6><p id=5 class=x data-k='ab c'></p></div>")
    assert " ".join(n.attrs["id"] for n in root.select(selector)) == want


def test_spans_and_odd_spans():
    table = M.tree("<table><tr><td rowspan=0 colspan=x>a<td rowspan=99999999999>b<tr><td colspan='2'>c</table>").select("table")[0]
    assert [[c[0] for c in row] for row in M.grid(table)] == [["a", "b"], ["c", "c"]]  # cells that overlap: the later one
    assert len(M.grid(M.tree("<table><tr><td colspan=999999999>a</table>").select("table")[0])[0]) == M.WIDEST
    assert M.table_map(M.tree("<table></table>").select("table")[0]) == {}


def test_sections_and_hidden_text():
    root = M.tree("<h1>A</h1>x<script>no</script><p>y<h2>B <b>c</b></h2><h2>A</h2>z<style>no")
    assert M.sections(root) == {"A": "x\ny\nz", "B c": ""}


def test_deep_and_long_markup_is_read():
    deep = M.tree("<i>" * 20_000 + "x")
    assert deep.text() == "x" and len(deep.select("i")) == 20_000
    assert len(M.tree("<p>a" * 20_000).select("p")) == 20_000


def test_odd_pages(spark):
    """Null and empty pages, no number, unfinished tags, equal rows; other columns do not matter."""
    part = "<table><tr><td>ACME x-1 <a href='moreinfo.php?1'>i</a> $5.00 7B0199279A"
    rows = [(1, "http://h/a/", "Acme", "X1", part), (1, "http://h/a/", "Acme", "X1", part), (2, None, "Acme", "X1", part), (3, "", "Acme", None, part), (4, "", None, "X1", part), (5, "", "A", "X1", None), (6, "", "A", "X1", ""), (7, "", "Acme", "X1", part + "<a href="), (None, "", "Acme", "X1", part)]
    frame = spark.createDataFrame(rows, "page_id int, url string, brand string, number string, html string").withColumn("place", F.lit(1)).withColumn("h", F.lit(2))
    got = sorted(((r.page_id or 0, r.listing_url, r.price, r.refs) for r in P.listings(frame).collect()))
    one = ("$5.00", ["7B0199279A"])
    assert got == [(0, "moreinfo.php?1", *one), (1, "http://h/a/moreinfo.php?1", *one), (1, "http://h/a/moreinfo.php?1", *one), (2, "moreinfo.php?1", *one), (4, "moreinfo.php?1", *one), (7, "moreinfo.php?1", *one)]
    details = {r.page_id: r.d for r in frame.select("page_id", P.page_details("html").alias("d")).collect()}
    assert details[5].specs == {} and details[6].warranty is None and details[5].others == []
    assert P.listings(frame.limit(0)).count() == 0


def test_listings_after_a_text_function_was_used(spark):
    """A used UDF holds on to the JVM and can't travel: the table function must not take the module of text functions along."""
    frame = spark.createDataFrame([(1, "http://h/", "Acme", "X1", "<table><tr><td>ACME X1 <a href='moreinfo.php?1'>i</a>")], "page_id int, url string, brand string, number string, html string")
    assert frame.select(X.plain_text("brand")).first()[0] == "Acme"
    assert [r.listing_url for r in P.listings(frame).collect()] == ["http://h/moreinfo.php?1"]
