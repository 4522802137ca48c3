"""Scalar functions, the rule engine on hand-made pairs, the workbook source, sinks, and late stream data."""

import difflib
import zipfile

import pytest
from pyspark.sql import functions as F

from interlace.functions import text as X
from interlace.operators import scoring as S
from interlace.sources import sinks
from interlace.sources.xlsx import XlsxDataSource
from interlace.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("85", 85), ("85.7", 85), ("85%", 85), ("n/a", None), (None, None), ("-5%", 5)])
def test_parse_confidence(spark, text, want):
    assert one(spark, X.parse_confidence(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("2005-2007", [2005, 2006, 2007]), ("2009", [2009]), ("2009-2005", []), ("new", []), (None, [])])
def test_expand_years(spark, text, want):
    assert one(spark, X.expand_years(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("7B0199279A", True), ("AB 12345", False), ("WARRANTY", False), ("AB1", False), (None, False)])
def test_is_reference(spark, text, want):
    assert one(spark, X.is_reference(F.lit(text).cast("string"))) is want


def test_sequence_ratio_and_plain_text(spark):
    pairs = [("7B0199279A", "7B0199279"), ("abc", "xbc"), ("", ""), (None, "a")]
    got = [r.x for r in spark.createDataFrame(pairs, "a string, b string").select(X.sequence_ratio("a", "b").alias("x")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a is not None else None for a, b in pairs]
    assert one(spark, X.plain_text(F.lit(" ﬁne  café — 10 "))) == "fine cafe - 10"


def refs(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


@pytest.mark.parametrize("a, b, want", [((), ("A1",), 0.3), (("52-73883 ad",), ("5273883AD",), 1.0), (("5273883AC",), ("5273883AD",), 0.7), (("1234567XX",), ("7654321",), 0.0)])
def test_score_oem(spark, a, b, want):
    assert one(spark, S.score_oem(refs(*a), refs(*b))) == want


@pytest.mark.parametrize("a, b, want", [("Motor Mount", "motor mount", 1.0), ("Motor Mount", "Engine Mount", 0.5), ("Motor Mount", "Water Pump", 0.0), (None, "x", 0.3)])
def test_score_category(spark, a, b, want):
    assert one(spark, S.score_category(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


@pytest.mark.parametrize("a, b, want", [("2005 Ford", "fits Ford 2005", 1.0), ("2005 Ford", "2006 FORD", 0.6), ("2005 Ford", "2005 Jeep", 0.5), ("2005 Ford", "2009 Jeep", 0.0), ("red", "2005 Ford", 0.4)])
def test_score_fitment(spark, a, b, want):
    assert one(spark, S.score_fitment(F.lit(a), F.lit(b))) == want


def test_fitment_compat_compares_centuries(spark):
    assert one(spark, S.score_fitment(F.lit("2005 Ford"), F.lit("2009 Ford"), compat=True)) == 1.0


def specs(**kv):
    return F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("_", " "), v)])


def test_score_specs(spark):
    a = specs(Weight="10 lb", Material="Rubber", Colour="red")
    assert one(spark, S.score_specs(a, specs(weight="10.7 lb", material="RUBBER", colour="blue"))) == pytest.approx(2 / 3)
    assert one(spark, S.score_specs(a, specs(Size="1"))) == 0.3
    assert one(spark, S.score_specs(a, F.create_map().cast("map<string,string>"))) == 0.4


def verdict_of(spark, both_found=True, **scores):
    row = spark.range(1).select(F.lit(both_found).alias("both_found"), *[F.lit(float(scores[k])).alias(f"s_{k}") for k in S.WEIGHTS])
    return S.with_verdict(row).first()


def test_known_pair_is_likely_or_better(spark):
    r = verdict_of(spark, oem=1, category=1, description=0.5, fitment=0.4, specs=1, visual=0.4)
    assert (r.confidence, r.match_result, r.fitment_match, r.desc_match) == (80, "YES", "UNKNOWN", "PARTIAL")
    assert r.top_signals == "oem,category,description" and r.missing_info == "fitment year/make data, product images"


def test_verdict_rules(spark):
    assert verdict_of(spark, oem=0, category=0, description=0, fitment=0, specs=0, visual=0).match_result == "NO"
    assert verdict_of(spark, both_found=False, oem=0, category=0, description=0, fitment=0, specs=0, visual=0).match_result == "UNCERTAIN"
    assert verdict_of(spark, oem=0.3, category=0.3, description=0.4, fitment=0.0, specs=0.4, visual=0.2).confidence == 27


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Anchor" sheetId="1" r:id="rId1"/><sheet name="GMB" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>ENGINE MOUNT</t></si><si><r><t>AN</t></r><r><t>CHOR</t></r></si></sst>")
        head = '<row r="1"><c r="A1" t="inlineStr"><is><t>PART TYPE</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{head}<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2"><v>50</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{head}</sheetData></worksheet>")


def test_workbook_source(spark, tmp_path):
    workbook(tmp_path / "book.xlsx")
    spark.dataSource.register(XlsxDataSource)
    rows = spark.read.format("xlsx").option("columns", 4).load(str(tmp_path / "book.xlsx")).collect()
    assert [tuple(r) for r in rows] == [("Anchor", 2, "ENGINE MOUNT", "ANCHOR", None, "50")]


def test_workbook_sink(spark, tmp_path):
    """Odd signs, nulls, empty cells, a full workbook, a sheet that comes back, mode overwrite, a bad sheet name."""
    spark.dataSource.register(XlsxDataSource)
    odd = ["a", None, "", " <&> \"' ", "x\r\ny\t\u0001", "_x0041_", "ünï 🎯", "_x_", "7"]
    rows = [("A " if i % 20 < 12 else "B", v, str(i)) for i, v in enumerate(odd * 10)]
    df = spark.createDataFrame(rows, "sheet_name string, v string, n string").coalesce(1)
    path = f"{tmp_path}/books"
    key = lambda r: (r[0], int(r[2]))
    read = lambda: sorted(((r.sheet_name, r.c1, r.c2) for r in spark.read.format("xlsx").option("columns", 2).load(path).collect()), key=key)
    df.write.format("xlsx").mode("append").option("rows", 25).save(path)
    assert read() == sorted(rows, key=key)
    assert len(list((tmp_path / "books").glob("*.xlsx"))) >= 4 and not list((tmp_path / "books").glob(".*.xlsx"))
    df.repartition(3).limit(5).write.format("xlsx").mode("append").save(path)
    assert len(read()) == 95
    df.sortWithinPartitions("sheet_name").write.format("xlsx").mode("overwrite").save(f"file:{path}")
    assert read() == sorted(rows, key=key) and len(list((tmp_path / "books").glob("*.xlsx"))) == 1
    with pytest.raises(Exception, match="can't name a sheet"):
        spark.sql("SELECT 'a/b' AS sheet_name, 'x' AS v, 'y' AS n").write.format("xlsx").mode("append").save(path)
    assert read() == sorted(rows, key=key)
    df.filter("false").write.format("xlsx").mode("overwrite").save(path)
    assert not list((tmp_path / "books").glob("*.xlsx"))


def test_sinks(spark, tmp_path):
    rows = spark.sql("SELECT 'A' sheet_name, 'YES' match_result, timestamp_ntz'2024-01-02 03:04:05' last_checked UNION ALL SELECT 'B', NULL, NULL")
    sinks.write_results(rows, f"{tmp_path}/results")
    assert {(r.sheet_name, r.colour, r.checked) for r in spark.read.parquet(f"{tmp_path}/results").collect()} == {("A", "C6EFCE", "2024-01-02 03:04"), ("B", "FFFFFF", None)}
    sinks.export_json(rows.select("sheet_name", "match_result"), f"{tmp_path}/json")
    assert '{"sheet_name":"B","match_result":null}' in {r.value for r in spark.read.text(f"{tmp_path}/json").collect()}
    sinks.write_report(rows, f"{tmp_path}/report", "'rows: ' || count(*)", "'confirmed: ' || count_if(match_result = 'YES')")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["rows: 2", "confirmed: 1"]
    assert sinks.snapshot(rows, f"{tmp_path}/snap", "s1").endswith("/s1")


def test_late_events_are_dropped(spark, tmp_path):
    """The third file brings an event of an hour that the watermark closed before; the fourth closes the rest."""
    for i, times in enumerate((["2024-01-01 00:10", "2024-01-01 03:00"], ["2024-01-01 02:55"], ["2024-01-01 00:20"], ["2024-01-02 00:00"])):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    stream = spark.readStream.schema("ts timestamp, f int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = stream.withWatermark("ts", "30 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    got = {r.start.hour: r.n for r in W.drain(counts.select(F.col("window.start").alias("start"), "n")).collect()}
    assert got == {0: 1, 2: 1, 3: 1}


def test_state_is_bounded(spark, tmp_path):
    rows = [(i, "a", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", 100.0 if i < 1200 else 10.0) for i in range(1230)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, t string, value double").selectExpr("event_id", "event_type", "cast(t as timestamp) ts", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    r = W.drain(W.anomaly_stream(stream)).first()
    assert (r.samples, r.recent, r.dropped) == (1000, 10.0, True)


def test_tables_are_made_and_widened(spark):
    from interlace.operators import ingest

    spark.sql("CREATE DATABASE IF NOT EXISTS interchange_t")
    spark.sql("CREATE TABLE interchange_t.site_configs (site_name STRING) USING parquet")
    try:
        for _ in range(2):
            ingest.create_tables(spark, "interchange_t")
        assert spark.table("interchange_t.site_configs").columns == ["site_name", "is_active", "rate_limit_delay", "success_rate"]
        assert len(spark.catalog.listTables("interchange_t")) == len(ingest.TABLES)
        assert ingest.ask(spark, "SELECT :a || 'x' AS v", a="1' OR '1").first().v == "1' OR '1x"
    finally:
        spark.sql("DROP DATABASE interchange_t CASCADE")


def test_metrics_keep_the_newest(spark, tmp_path):
    ddl = "ts long, metric_name string, value double"
    for lo in (0, 10):
        sinks.append_metrics(spark.createDataFrame([(i, "cpu", float(i)) for i in range(lo, lo + 10)], ddl), f"{tmp_path}/m")
    assert sorted(r.ts for r in sinks.load_metrics(spark, f"{tmp_path}/m", ddl, 3).collect()) == [17, 18, 19]


def test_plain_text_follows_the_rule(spark):
    """Accents, ligatures, fractions, odd blanks, signs of the map and outside cp1252, empty and missing texts."""
    from interlace.operators.extraction import SIGNS

    cases = [*SIGNS, ("  two   blanks ", "two blanks"), ("", ""), (None, ""), ("é", "e"), ("\u0081x", "x")]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    assert {r.id: r.p for r in rows.select("id", X.plain_text("t").alias("p")).collect()} == dict(enumerate(p for _, p in cases))


def test_plain_json_keeps_everything_but_strings(spark):
    cases = [
        ('{"a™": ["°", {"b": null, "c": 12345678901234567890, "—": "…"}], "d": false}', '{"aTM": ["deg", {"b": null, "c": 12345678901234567890, "-": "..."}], "d": false}'),
        ("[]", "[]"), ('"x®"', '"x(R)"'), ("3", "3"), (None, None), ("no json °", "no json deg"), ("[" * 100_000, "[" * 100_000), ('{"™": 1, "TM": 2}', '{"TM": 2}'), ("", ""),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    assert {r.id: r.p for r in rows.select("id", X.plain_json("t").alias("p")).collect()} == dict(enumerate(p for _, p in cases))


def test_sequence_ratio(spark):
    """Overlaps, swapped blocks, nothing in common, empty and missing references; counted by hand."""
    cases = [
        ("7B0199279A", "7B0199279", 0.947368), ("5273883AD", "5273883AC", 0.888889), ("ABC", "ABC", 1.0), ("ABC", "XYZ", 0.0), ("", "", 1.0), ("A", "", 0.0),
        ("ABCD", "BCDE", 0.75), ("AB12", "12AB", 0.5), ("1234567XX", "5273883AD", 0.222222), (None, "A", None),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, a string, b string")
    assert {r.id: r.r for r in rows.select("id", F.round(X.sequence_ratio("a", "b"), 6).alias("r")).collect()} == {i: c[2] for i, c in enumerate(cases)}


def test_odd_cells(spark):
    """A cell and what it means as a confidence, a price, and years."""
    cells = [
        ("85", 85, 85.0, ""), ("85.7", 85, 85.7, ""), ("85%", 85, None, ""), ("n/a", None, None, ""), (None, None, None, ""), ("", None, None, ""), ("about 70 to 80", 70, None, ""), ("-5", -5, -5.0, ""),
        ("$1,234.50", 1, 1234.5, ""), ("2005-2007", 2005, None, "2005,2006,2007"), ("2007-2005", 2007, None, ""), ("1999", 1999, 1999.0, "1999"), ("2005 - 2006", 2005, None, "2005,2006"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cells)], "id int, cell string")
    years = F.coalesce(F.array_join(F.transform(X.expand_years(F.col("cell")), lambda y: y.cast("string")), ","), F.lit(""))
    got = rows.select("id", X.parse_confidence(F.col("cell")).alias("c"), X.parse_price(F.col("cell")).alias("p"), years.alias("y")).collect()
    assert {r.id: (r.c, r.p, r.y) for r in got} == {i: c[1:] for i, c in enumerate(cells)}
