import datetime

from pyspark.sql import functions as F

from corpuslens.functions import text as t
from corpuslens.operators import context, export, metadata, reports
from corpuslens.sources import tables
from corpuslens.streaming import time_series


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_dates_are_clamped(spark):
    got = column(spark, ["1847", "1847-13-40", "1847-02-31", "x", None, "1848-02-30"], t.clamped_date)
    assert got == [datetime.date(1847, 1, 1), datetime.date(1847, 1, 1), datetime.date(1847, 2, 28), datetime.date(9999, 12, 31), datetime.date(9999, 12, 31), datetime.date(1848, 2, 29)]


def test_integers(spark):
    assert column(spark, ["12a", "-3", "x", None], t.leading_integer) == [12, -3, None, None]
    assert column(spark, ["ca. 1850", "300 BC", "-44", "1850-1860"], t.first_integer) == [1850, -300, -44, 1850]


def test_folding_and_natural_order(spark):
    assert column(spark, ["Été", "ÑÜ"], t.fold) == ["ete", "nu"]
    names = ["act 10", "act 9", "act 1"]
    assert sorted(names, key=dict(zip(names, column(spark, names, t.natural_sort_form))).get) == ["act 1", "act 9", "act 10"]


def test_corpus_order_and_year(spark):
    docs = spark.createDataFrame([("b", "1850", None), ("a", "1799 or 1801", "1700"), ("c", None, "-50")], "title string, date string, create_date string")
    assert {r.title: r.y for r in docs.select("title", tables.derived_year(docs).alias("y")).collect()} == {"b": 1850, "a": 1700, "c": -50}
    assert [r.title for r in tables.corpus_order(docs, ["title"]).orderBy("doc").collect()] == ["a", "b", "c"]


def test_headers(spark):
    xml = spark.createDataFrame([("<h><titleStmt><author> A. </author></titleStmt><creation><date>none</date></creation></h>",)], "h string")
    row = xml.select(*tables.tei_header("h")).first()
    assert (row.author, row.create_date) == ("A.", None)
    html = spark.createDataFrame([('<meta name="DC.Creator" content="X"><meta content="2" name="DC.date">',)], "h string")
    assert html.select(tables.dublin_core(F.col("h")).alias("m")).first().m == {"creator": "X", "date": "2"}


def test_paths_that_a_header_lacks_are_not_parsed(spark):
    found = spark.createDataFrame([("<h><titleStmt><title>T</title></titleStmt></h>",), ("<h><publicationStmt><idno>7</idno></publicationStmt><b></h>",)], "h string")
    # the second header isn't well-formed, which only the fields that it names could notice
    assert [r.title for r in found.select(tables.tei_header("h", {"title": tables.TEI_HEADER["title"]})[0]).collect()] == ["T", None]


def test_bibliography(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("filename\tyear\na.txt\t1850\nb.txt\tx\n")
    assert [r.year for r in tables.bibliography(spark, str(tmp_path / "b.tsv")).orderBy("filename").collect()] == [1850, 0]


def test_division_inheritance(spark):
    key = "doc int, div1 int, div2 int, div3 int"
    divs = spark.createDataFrame([("div1", 1, 1, 0, 0, "one"), ("div2", 1, 1, 1, 0, "")], f"level string, {key}, head string")
    rows = spark.createDataFrame([(1, 1, 1, 1)], key)
    assert metadata.inherit(rows, divs, "head").first().head == "one"


def test_three_valued_not_and_ranges(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 15), (3, "b", None)], "doc int, f string, n int")
    pick = lambda q, **k: sorted(r.doc for r in metadata.select_objects(rows, q, k).collect())
    assert pick({"f": "NOT a"}) == [3]
    assert pick({"f": "NULL"}) == [2] and pick({"f": "NOT NULL"}) == [1, 3]
    assert pick({"n": "10-"}, n="int") == [2] and pick({"n": "-10"}, n="int") == [1] and pick({"n": "NOT 1-10"}, n="int") == [2]


def test_page_bounds():
    assert metadata.bounds(0, 0, 25, 100) == (1, 25) and metadata.bounds(90, 0, 25, 100) == (90, 100) and metadata.bounds(1, 0, 25, 0) == (0, 0)


def test_time_series_has_every_range(spark):
    docs = spark.createDataFrame([(1, 1805), (2, 1831), (3, None)], "doc int, year int")
    got = [(r["first"], r["last"], r.n) for r in reports.time_series(None, docs, "year", 1800, 1835, 10).orderBy("first").collect()]
    assert got == [(1800, 1809, 1), (1810, 1819, 0), (1820, 1829, 0), (1830, 1835, 1)]


def test_citations_and_export(spark, tmp_path):
    works = spark.createDataFrame([("Ham.", "Hamlet"), ("H", "Henry")], "abbreviation string, work string")
    cites = spark.createDataFrame([("Ham. 1.2",)], "cite string")
    row = context.resolve_citation(cites, works).first()
    assert (row.work, row.rest) == ("Hamlet", "1.2")
    export.write(spark.createDataFrame([(1, [1, 2], "<b>x</b>")], "a int, b array<int>, c string"), str(tmp_path / "o"), "csv", strip=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().asDict() == {"a": "1", "b": "[1,2]", "c": "x"}


def test_citations_are_read_once(spark, tmp_path):
    spark.createDataFrame([(k, c) for k in range(50) for c in ("Ham. 1.2", "Hamlet", "Xy", "", None)], "k int, cite string").write.parquet(str(tmp_path / "c"))
    cites = spark.read.parquet(str(tmp_path / "c"))
    works = spark.createDataFrame([("Ham.", "Hamlet"), ("H", "Henry"), ("Hamlet, Prince", "Long")], "abbreviation string, work string")
    out = context.resolve_citation(cites, works)
    assert sorted({(r.cite, r.work, r.rest) for r in out.collect()}) == [("Ham. 1.2", "Hamlet", "1.2"), ("Hamlet", "Henry", "amlet")] and out.count() == 100
    # a small file may hold many rows: no side that is broadcast unseen may come of it
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_stream_equals_table(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    time_series.run_to_table(stream, "streamed", str(tmp_path / "cp"))
    key = lambda rows: sorted((r.start, r.grp, r.n, round(r.total, 6)) for r in rows)
    assert key(spark.table("streamed").collect()) == key(time_series.windowed_counts(table).collect())
