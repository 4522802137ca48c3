"""Extraction of fields, links and fitments from pages and texts: regular expressions first, an HTML parser where needed."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from interlace.functions import text as X
from interlace.plans.model import WITH, match_rows
from interlace.plans.registry import bounded_batches, read, register


@register("page_fields", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Title, language, paragraphs and host of each page."""
    h = F.col("html")
    return read(spark, sf, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit("<p>")).alias("paragraphs"), F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1).alias("host"))


class _Links(HTMLParser):
    """Links of a page: address and text."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.inside = True
            self.links.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.links[-1][1] += data


class PageLinks:
    """Table function from a page to its links."""

    def eval(self, html: str):
        parser = _Links()
        parser.feed(html or "")
        for i, (href, label) in enumerate(parser.links):
            yield i, href, label


@register("page_links", r"WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages), n AS (SELECT page_id, hrefs, unnest(range(0, len(hrefs))) AS place FROM l) SELECT page_id, CAST(place AS INT) AS place, replace(hrefs[place + 1], '&amp;', '&') AS href FROM n")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links by the HTML parser, one row each."""
    spark.udtf.register("page_links", udtf(PageLinks, returnType="place int, href string, label string"))
    read(spark, sf, "pages").createOrReplaceTempView("pages_to_parse")
    return spark.sql("SELECT page_id, l.place, l.href FROM pages_to_parse, LATERAL page_links(html) AS l")


@register("page_images", r"WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:img|a)[^>]*(?:src|href)=\"([^\"]*)\"', 1)) AS src FROM pages) SELECT page_id, src FROM i")
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of images and of what pages link to, in order of appearance."""
    found = F.regexp_extract_all("html", F.lit(r'<(?:img|a)[^>]*(?:src|href)="([^"]*)"'), F.lit(1))
    return read(spark, sf, "pages").select("page_id", F.explode(found).alias("src"))


_FIT = "'Ford F' || p_size || ' ' || (1995 + p_size % 10) || '-' || (1996 + p_size % 10 + p_size % 3) || ' ; Honda Civic ' || (2000 + p_size % 7)"


@register("fitment_rows", f"WITH f AS (SELECT p_partkey AS part, unnest(string_split({_FIT}, ' ; ')) AS f FROM part), y AS (SELECT part, regexp_extract(f, '^(\\w+) (\\w+) ([0-9]{{4}})', 1) AS make, regexp_extract(f, '^(\\w+) (\\w+) ([0-9]{{4}})', 2) AS model, CAST(regexp_extract(f, ' ([0-9]{{4}})', 1) AS INT) AS a, CAST(regexp_extract(f, '([0-9]{{4}})$', 1) AS INT) AS b FROM f) SELECT part, make, model, CAST(unnest(range(a, b + 1)) AS INT) AS year FROM y")
def fitment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A fitment text becomes a row for each vehicle and year."""
    s = F.col("p_size")
    text = F.concat(F.lit("Ford F"), s.cast("string"), F.lit(" "), (1995 + s % 10).cast("string"), F.lit("-"), (1996 + s % 10 + s % 3).cast("string"), F.lit(" ; Honda Civic "), (2000 + s % 7).cast("string"))
    one = read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.explode(F.split(text, " ; ")).alias("f"))
    named = one.select("part", F.split("f", " ")[0].alias("make"), F.split("f", " ")[1].alias("model"), X.expand_years(F.split("f", " ")[2]).alias("years"))
    return named.select("part", "make", "model", F.explode("years").alias("year"))


@register("price_parse", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price FROM lineitem")
def price_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as they stand on pages become numbers; a text without one becomes null."""
    shown = F.when(F.col("l_linenumber") == 3, "call us").otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.parse_price(shown).alias("price"))


@register("parse_cells", "SELECT p_partkey AS part, CASE p_size % 5 WHEN 0 THEN 85 WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE NULL END AS confidence, CASE p_size % 4 WHEN 0 THEN TIMESTAMP '2024-02-03 04:05:06' WHEN 1 THEN TIMESTAMP '2024-02-03 04:05:00' WHEN 2 THEN TIMESTAMP '2024-02-03 00:00:00' END AS seen, p_size % 6 IN (0, 1) AS blank FROM part")
def parse_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Raw cells: confidence, time, and placeholders for blank."""
    s = F.col("p_size")
    number = F.when(s % 5 == 0, "85.7").when(s % 5 == 1, F.concat(s.cast("string"), F.lit("%"))).when(s % 5 == 2, s.cast("string")).when(s % 5 == 3, "n/a")
    time = F.when(s % 4 == 0, "2024-02-03 04:05:06").when(s % 4 == 1, "2024-02-03 04:05").when(s % 4 == 2, "2024-02-03").otherwise("yesterday")
    cell = F.when(s % 6 == 0, " N/A ").when(s % 6 == 1, "--").otherwise("P77")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), X.parse_confidence(number).alias("confidence"), X.parse_time(time).cast("timestamp_ntz").alias("seen"), X.is_blank(cell).alias("blank"))


@register("valid_references", WITH + "SELECT part_number, skp_part_number, regexp_matches(skp_part_number, '^[A-Za-z0-9-]{6,15}$') AS valid, regexp_replace(regexp_replace(upper(skp_part_number), '[ -]', '', 'g'), '[A-Z]{1,2}$', '') AS base FROM m WHERE call12 > 40")
def valid_references(spark: SparkSession, sf: str) -> DataFrame:
    """Which numbers can be references, and their base numbers."""
    return match_rows(spark, sf).filter("call12 > 40").select("part_number", "skp_part_number", X.is_reference(F.col("skp_part_number")).alias("valid"), X.base_reference(F.col("skp_part_number")).alias("base"))


@register("url_fitment", "SELECT p_partkey AS part, upper(split_part(p_name, ' ', 1)) AS make, CAST(1990 + p_size AS INT) AS year, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS model FROM part")
def url_fitment(spark: SparkSession, sf: str) -> DataFrame:
    """Make, year and model out of a catalogue address."""
    url = F.concat(F.lit("https://site/catalog/"), F.split("p_name", " ")[0], F.lit(","), (1990 + F.col("p_size")).cast("string"), F.lit(","), F.split("p_name", " ")[1], F.lit("+"))
    parts = F.split(F.substring_index(url, "/catalog/", -1), ",")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.upper(parts[0]).alias("make"), parts[1].cast("int").alias("year"), F.trim(F.initcap(F.translate(parts[2], "+", " "))).alias("model"))


@register("config_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'none' AS missing, md5(props) AS fingerprint FROM events")
def config_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A value by its path in a nested document, a default where the path leads nowhere, and a content digest."""
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"), F.md5(F.substring("props", 1, 4096)).alias("fingerprint"))


# Pieces of text and what the rule makes of them, worked out by hand from the map and the cp1252 table.
SIGNS = [
    ("50°C €9", "50 deg C €9"), ("Brand™ ®©", "BrandTM (R)(C)"), ("a—b–c", "a - b - c"), ("\u2018q\u2019 \u201cw\u201d", "'q' \"w\""), ("wait…", "wait..."), ("【x】", "[x]"), ("🎯🔧⚙\ufe0f", "[TARGET][TOOL][GEAR]"),
    ("ﬁlter ½", "filter 1⁄2".replace("⁄", "")), ("你好", ""), ("Œuvre ƒ ‰", "Œuvre ƒ ‰"), ("x\u00a0\u2003y", "x y"), ("\u0007bell", "\u0007bell"), ("😀 ok", "ok"), ("café", "cafe"),
]
_quoted = lambda v: "'" + v.replace("'", "''") + "'"
_SIGN_SQL, _PLAIN_SQL = ("[" + ", ".join(_quoted(s[i]) for s in SIGNS) + "]" for i in (0, 1))


def _sign(key: str) -> Column:
    """One of the pieces for each row, by its key."""
    return F.element_at(F.array(*[F.lit(s) for s, _ in SIGNS]), (F.col(key) % len(SIGNS) + 1).cast("int"))


@register("plain_documents", rf"SELECT doc_id, trim(regexp_replace(strip_accents(text) || ' ' || ({_PLAIN_SQL})[doc_id % {len(SIGNS)} + 1], '\s+', ' ', 'g')) AS plain FROM documents")
def plain_documents(spark: SparkSession, sf: str) -> DataFrame:
    """C15 over all documents, each with one of the pieces at its end."""
    bounded_batches(spark)
    return read(spark, sf, "documents").select("doc_id", X.plain_text(F.concat_ws(" ", F.coalesce("text", F.lit("")), _sign("doc_id"))).alias("plain"))


def _nested(sign: str, plain: bool = False) -> str:
    """SQL for a JSON text around props and a sign (an expression), as it is or as it becomes plain."""
    key = "_ (R)" if plain else "_ ®"
    return f"""concat('{{"old": ', props, ', "{key}": [', to_json({sign}), ', null, true, 1.5, ["x{'TM' if plain else '™'}", {{"deep": {{"deeper": ', to_json({sign}), '}}}}]], "none": {{}}}}')"""


@register("plain_props", f"SELECT event_id, {_nested(f'(({_PLAIN_SQL})[event_id % {len(SIGNS)} + 1])', True)} AS plain FROM events WHERE ({_PLAIN_SQL})[event_id % {len(SIGNS)} + 1] NOT LIKE '%bell%'")
def plain_props(spark: SparkSession, sf: str) -> DataFrame:
    """C15 inside nested values: every string of the props of events, with pieces planted in keys, lists and objects."""
    rows = read(spark, sf, "events").filter(~_sign("event_id").contains("bell"))
    quoted = F.concat(F.lit('"'), F.replace(_sign("event_id"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nested = F.concat(
        F.lit('{"old": '), "props", F.lit(', "_ ®": ['), quoted, F.lit(', null, true, 1.5, ["x™", {"deep": {"deeper": '), quoted, F.lit('}}]], "none": {}}')
    )
    return rows.select("event_id", X.plain_json(nested).alias("plain"))
