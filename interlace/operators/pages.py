"""Listings, sections and tables of pages, from a tree of each page's markup."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from interlace.functions import markup as M
from interlace.functions.text import NOT_REFERENCES  # not the module: it holds UDFs, which can't travel to executors once used
from interlace.plans.registry import bounded_batches, read, register

# Where listings, headings of part types, other references, notes and warranties stand in a page.
LINKS = "a[href*='moreinfo.php']"
AROUND = "tr, .listing-col-wrap, [class*='listing'], div"
KINDS = "[class*='parttype'], [class*='category'], h2, h3"
OTHERS, NOTES, WARRANTY = "section[aria-label*='Alternate/OEM Part Number']", "div.listing-text-row", "table.warranty"
WARRANTY_WORDS = ("warranty", "closeout", "return policy")
NO_REFERENCES = ("SEARCH", "MOREINFO", "FILTER", "VEHICLE", "CATALOG")
#: Levels above a link within which its part type may stand, and entries of a listing's references, notes and others.
LEVELS, MOST_REFERENCES, MOST_NOTES, MOST_OTHERS = 10, 8, 5, 10


def _squeezed(text: str) -> str:
    return re.sub(r"[\s-]", "", text.upper())


def _kind_above(link: M.Node) -> str | None:
    """The nearest heading of a part type: the first one inside the closest elements around the link."""
    node = link.parent
    for _ in range(LEVELS):
        if node is None:
            return None
        found = next((t for n in node.select(KINDS) if len(t := n.text()) > 2), None)
        if found:
            return found.split("\n")[0]
        node = node.parent
    return None


def listings_of(html: str | None, base: str | None, brand: str | None, number: str | None):
    """(place, url, kind, price, popular, references) for each link to details whose surroundings name brand and number."""
    brand, number = (brand or "").upper(), number or ""
    if not number:
        return
    for place, link in enumerate(M.tree(html).select(LINKS)):
        around = link.parent.closest(AROUND) if link.parent is not None else None
        text = around.text().upper() if around is not None else ""
        if brand not in text or not (number.upper() in text or _squeezed(number) in _squeezed(text)):
            continue
        price = re.search(r"\$(\d+\.\d{2})", text)
        words = re.findall(r"\b([A-Z0-9]{6,})\b", text.split("WARRANTY")[0] or text)
        known = {brand, _squeezed(number), *NO_REFERENCES, *NOT_REFERENCES}
        references = [w for w in words if w not in known and len(w) <= 15][:MOST_REFERENCES]
        yield place, urljoin(base or "", link.attrs["href"]), _kind_above(link), price.group(0) if price else None, "POPULAR" in text, references


class PageListings:
    """Table function from a page, its address, a brand and a number to the listings of that part."""

    def eval(self, html: str, base: str, brand: str, number: str):
        yield from listings_of(html, base, brand, number)


LISTING = "place int, listing_url string, kind string, price string, popular boolean, refs array<string>"


def details_of(html: str | None) -> dict:
    """Sections, tables, other references, warranty and notes of a page."""
    root = M.tree(html)
    specs: dict[str, str] = {}
    for table in root.select("table"):
        for key, value in M.table_map(table).items():
            specs.setdefault(key, value)
    others = []
    for section in root.select(OTHERS):
        after = section.text().split("Alternate Inventory Numbers:")
        others += re.findall(r"\b([A-Z0-9]{4,})\b", re.sub("[{}]", "", after[-1]).upper()) if len(after) > 1 else []
    rows = [t for n in root.select(NOTES) if len(t := " ".join(n.text().split())) > 10]
    warranty = next((t[:200] for t in reversed(rows) if any(w in t.lower() for w in WARRANTY_WORDS)), None)
    warranty = next((t[:300] for n in root.select(WARRANTY) if "warranty" in (t := " ".join(n.text().split())).lower()), warranty)
    notes = [t[:150] for t in rows if not any(w in t.lower() for w in WARRANTY_WORDS)]
    return {"sections": M.sections(root), "specs": specs, "others": others[:MOST_OTHERS], "warranty": warranty, "notes": notes[:MOST_NOTES]}


_TEXTS, _MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


@F.pandas_udf(T.StructType().add("sections", _MAP).add("specs", _MAP).add("others", _TEXTS).add("warranty", T.StringType()).add("notes", _TEXTS))
def page_details(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([details_of(h) for h in html], columns=["sections", "specs", "others", "warranty", "notes"])


def with_parts(spark: SparkSession, sf: str) -> DataFrame:
    """pages with the brand and number of a part, and listings, tables and notes of it in the page: one to three listings, cells
    and rows that are never closed, another brand's listing, spans, and a wrong end."""
    k = F.col("page_id")
    brand, number = F.element_at(F.array(*map(F.lit, ("ANCHOR", "DORMAN"))), (k % 2 + 1).cast("int")), F.concat(F.lit("P-"), F.lpad((k % 100).cast("string"), 4, "0"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    listing = lambda i: text(
        "<tr class=row><td><b>", F.lower(brand), "</b> P", F.lpad((k % 100).cast("string"), 4, "0"), " <a href='/moreinfo.php?pk=", k, "&amp;n=", i, "'>Info</a><td>7B", F.lpad((k * 10 + i).cast("string"), 7, "0"), ", CATALOG <td>$", (k % 90 + 10), ".", F.lpad((i * 7 % 100).cast("string"), 2, "0"), F.when(i % 2 == 0, " Popular").otherwise(""), " Warranty ABCDEFG1",
    )
    rows = F.array_join(F.transform(F.sequence(F.lit(1), k % 3 + 1), listing), "")
    planted = text(
        "<div><h3 class=parttype>Motor <i>Mount</i></h3><table class=listings>", rows, "<tr><td>OTHER P", (k % 100), " <a href=/moreinfo.php?pk=0>Info</a> $1.00</table></div></span>",
        '<section aria-label="Alternate/OEM Part Number(s)">{Alternate Inventory Numbers: POF', F.lpad((k % 1000).cast("string"), 4, "0"), ":8}</section>",
        "<h2>Fitment</h2><p>Fits ", k, "<p>and more<h2>Data &amp; sizes</h2>",
        "<table><tr><th>Field<th>Front<th>Rear<tr><th>Bolt<td>", k % 7, "<td>", k % 5, "<tr><th>Nut<td colspan=2>", k % 3, "</table>",
        "<table><tr><th rowspan=2>Bore<th>inner<td>", k % 11, "<tr><th>outer<td>", k % 13, "</table>",
        "<div class=listing-text-row>Limited Warranty of ", k % 36, " months</div><div class='x listing-text-row'>Sold in pairs, ", k, " left</div>",
    )
    cut = F.instr("html", "</article>")
    html = F.concat(F.left("html", cut - 1), planted, F.substr("html", cut))
    return read(spark, sf, "pages").select("page_id", "url", brand.alias("brand"), number.alias("number"), html.alias("html"))


def listings(pages: DataFrame, key: str = "page_id", url: str = "url", brand: str = "brand", number: str = "number", html: str = "html") -> DataFrame:
    """(key and LISTING) for each listing of the part of each row of pages; rows without one, or without a number, give none."""
    spark = pages.sparkSession
    spark.udtf.register("page_listings", udtf(PageListings, returnType=LISTING))
    rows = pages.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in ((html, "h"), (url, "u"), (brand, "b"), (number, "n"))])
    rows.createOrReplaceTempView("pages_with_listings")
    return spark.sql(f"SELECT __key AS `{key}`, l.* FROM pages_with_listings, LATERAL page_listings(h, u, b, n) AS l")


@register("page_listings", "SELECT page_id, CAST(i - 1 AS INT) AS place, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/moreinfo.php?pk=' || page_id || '&n=' || i AS listing_url, 'Motor Mount' AS kind, '$' || (page_id % 90 + 10) || '.' || lpad(CAST(i * 7 % 100 AS VARCHAR), 2, '0') AS price, i % 2 = 0 AS popular, '7B' || lpad(CAST(page_id * 10 + i AS VARCHAR), 7, '0') || CASE WHEN i % 2 = 0 THEN ',POPULAR' ELSE '' END AS refs FROM (SELECT *, unnest(range(1, page_id % 3 + 2)) AS i FROM pages)")
def page_listings(spark: SparkSession, sf: str) -> DataFrame:
    """All listings of a page's part: address, part type above, price, popularity, references."""
    return listings(with_parts(spark, sf)).withColumn("refs", F.array_join("refs", ","))


def _entries(column: str) -> Column:
    """A map as text, entries in order of their keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


@register("page_tables", "SELECT page_id, concat('Bolt Front=', page_id % 7, ';Bolt Rear=', page_id % 5, ';Bore inner=', page_id % 11, ';Bore outer=', page_id % 13, ';Nut Front=', page_id % 3, ';Nut Rear=', page_id % 3) AS specs, 'POF' || lpad(CAST(page_id % 1000 AS VARCHAR), 4, '0') AS others, concat('Limited Warranty of ', page_id % 36, ' months') AS warranty, concat('Sold in pairs, ', page_id, ' left') AS notes, concat('Fits ', page_id, chr(10), 'and more') AS fitment FROM pages")
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a page as one map (without its listings), other references, warranty, notes, and a section."""
    bounded_batches(spark)
    rows = with_parts(spark, sf).select("page_id", page_details("html").alias("d")).select("page_id", "d.*")
    specs = rows.withColumn("specs", F.map_filter("specs", lambda key, _: key.rlike("^(Bolt|Bore|Nut)")))
    return specs.select("page_id", _entries("specs").alias("specs"), F.array_join("others", ",").alias("others"), "warranty", F.array_join("notes", "|").alias("notes"), F.element_at("sections", F.lit("Fitment")).alias("fitment"))
