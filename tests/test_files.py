"""Workbooks, crawls and run records through files."""

import zipfile
from datetime import date
from decimal import Decimal
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from marketglass.sources import crawl, market, workbook
from marketglass.streaming import captures, runs


def cells(path):
    """Sheets by name, as rows of values by column."""
    ns = {"m": workbook.MAIN}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{workbook.MAIN}}}sheet")]
        out = {}
        for k, name in enumerate(names, 1):
            rows = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).findall("m:sheetData/m:row", ns)
            out[name] = [{c.get("r").rstrip("0123456789"): c.findtext("m:v", None, ns) if c.get("t") is None else "text:" + (c.findtext("m:is/m:t", "", ns) or "") for c in row.findall("m:c", ns)} for row in rows]
        return out


def test_a_report_is_one_file_with_two_sheets(spark, tmp_path):
    report = spark.createDataFrame([(2, "=cmd()", Decimal("1.50"), date(2026, 1, 2)), (1, "a < b & \"c\"\x01", None, None)], "id int, `na.me` string, gap_pct decimal(9,2), day date")
    summary = spark.createDataFrame([("tracked", 2)], "what string, n long")
    path = str(tmp_path / "r.xlsx")
    market.export_report(report, path, "xlsx", summary=summary)
    got = cells(path)
    assert list(got) == ["Summary", "Competitor Details"]
    assert got["Summary"] == [{"A": "text:what", "B": "text:n"}, {"A": "text:tracked", "B": "2"}]
    head, *rows = got["Competitor Details"]
    assert head == {"A": "text:id", "B": "text:na.me", "C": "text:gap_pct", "D": "text:day"}
    assert sorted(rows, key=lambda r: r["A"]) == [{"A": "1", "B": 'text:a < b & "c"'}, {"A": "2", "B": "text:'=cmd()", "C": "1.50", "D": "text:2026-01-02"}]
    workbook.write_workbook({"only": report.limit(0)}, path)
    assert list(cells(path)) == ["only"] and len(cells(path)["only"]) == 1
    workbook.write_workbook({"s": spark.range(500, numPartitions=5)}, path, {"s": [F.col("id").desc()]})
    assert [r["A"] for r in cells(path)["s"][1:]] == [str(k) for k in range(499, -1, -1)]
    assert workbook.column(0) == "A" and workbook.column(25) == "Z" and workbook.column(26) == "AA" and workbook.column(702) == "AAA"


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(3).select(F.when(F.col("id") < 9, F.raise_error(F.lit("broken"))).alias("x"))
    with pytest.raises(Exception, match="broken"):
        workbook.write_workbook({"fine": spark.range(3), "bad": bad}, str(tmp_path / "r.xlsx"))
    assert list(tmp_path.iterdir()) == []


def site(top, lists):
    for k, (details, following) in lists.items():
        links = "".join(f'<a class="card product" href="{d}.html">x</a>' for d in details) + (f'<a class="next" href="{following}.html">more</a>' if following else "")
        (top / f"{k}.html").write_text(links)


def test_a_crawl_reads_each_page_once_and_goes_on(spark, tmp_path):
    spark.dataSource.register(crawl.CrawlPages)
    top = tmp_path / "site"
    top.mkdir()
    for d in ("d1", "d2", "d3", "d4"):
        (top / f"{d}.html").write_text(f"<h1>{d}</h1>")
    site(top, {"l1": (["d1", "d2", "d1"], "l2"), "l2": (["d2", "lost", "d3"], None)})
    stream = lambda: spark.readStream.format("crawl_pages").option("address", f"file://{top}/l1.html").option("frontier", str(tmp_path / "frontier")).load()

    def run():
        query = captures.start(stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds"), spark)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    rows = run()
    assert sorted((r.step, r.url.rsplit("/", 1)[1], r.body) for r in rows if r.error is None) == [(1, "d1.html", "<h1>d1</h1>"), (1, "d2.html", "<h1>d2</h1>"), (2, "d3.html", "<h1>d3</h1>")]
    assert [r.url.rsplit("/", 1)[1] for r in rows if r.error] == ["lost.html"]
    # Stopped and started again: nothing is read twice.
    assert len(run()) == 4


def test_one_row_a_run(spark, tmp_path):
    source, log = str(tmp_path / "in"), runs.Runs(spark, str(tmp_path / "runs"))
    spark.range(10).write.parquet(source)
    spark.streams.addListener(log)
    try:
        ids = []
        for fail in (False, True):
            stream = runs.counted(spark.readStream.schema("id long").parquet(source), F.col("id") % 4 == 0)
            stream = stream.withColumn("x", F.when(F.lit(fail), F.raise_error(F.lit("stopped here"))))
            writer = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{fail}")).option("checkpointLocation", str(tmp_path / f"state{fail}")).trigger(availableNow=True).queryName(f"run_{fail}")
            query = captures.start(writer, spark)
            ids.append(str(query.runId))
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001
                assert fail
            assert log.wait(ids[-1])
        rows = {r.name: r for r in log.table().collect()}
        assert (rows["run_False"].items, rows["run_False"].broken, rows["run_False"].error) == (10, 3, None)
        assert rows["run_False"].items == spark.read.parquet(str(tmp_path / "outFalse")).count()
        assert rows["run_True"].error and rows["run_True"].items == 0
        assert [rows["run_False"].run_id, rows["run_True"].run_id] == ids
    finally:
        spark.streams.removeListener(log)
