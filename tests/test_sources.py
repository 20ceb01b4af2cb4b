"""Sources, sinks and streams."""

import http.server
import threading
import time
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
import pytest
from conftest import SMALL

from crawlsight.operators.tables import site
from crawlsight.plans import health, summary
from crawlsight.sources import context, crawler, files, pages
from crawlsight.streaming.pages import each_batch, page_stream, stream_flags


def small_web():
    """A fetch function over four pages; a closure, so that executors need no test module."""
    web = {
        "https://s.example/": ("200", '<a href="/a">a</a><a href="/b#x">b</a><a href="https://o.example/">o</a>', None),
        "https://s.example/a": ("301", "", "https://s.example/c"),
        "https://s.example/b": ("404", "", None),
        "https://s.example/c": ("200", '<a href="/">start</a><a href="/secret/x">s</a><a href="/boom">x</a>', None),
    }

    def fetch(url):
        status, html, location = web[url]
        headers = {"Cache-Control": "no-cache", "Content-Type": "text/html"}
        return {"status": status, "html": html, "location": location, "seconds": 0.126, "headers": headers}

    return fetch


def test_crawl(spark):
    got = crawler.crawl_site(spark, "https://s.example/#top", small_web(), robots_txt="User-agent: *\nDisallow: /secret")
    rows = {r.url.removeprefix("https://s.example"): r for r in got.collect()}
    assert set(rows) == {"/", "/a", "/b", "/c", "/secret/x", "/boom"}
    assert rows["/"].crawl_status == "Success" and rows["/"].cache_control == "no-cache" and rows["/"].crawl_time_s == 0.13
    assert rows["/a"].redirect_target == "https://s.example/c" and rows["/b"].crawl_status == "HTTP Error"
    assert rows["/secret/x"].crawl_status == "Blocked by robots.txt" and rows["/boom"].crawl_status.startswith("Error")
    assert crawler.crawl_site(spark, "https://s.example/", small_web(), max_pages=2).count() == 2
    assert summary.overview(got).first().successful == 2


def test_crawl_takes_pages_in_queue_order_and_waits(spark):
    names = {"https://s.example/": ["z", "y", "a"], "https://s.example/z": ["m", "a"], "https://s.example/y": ["b"]}

    def fetch(url):
        html = "".join(f'<a href="/{n}">x</a>' for n in names.get(url, []))
        return {"status": 200, "html": html}

    taken = lambda n: {r.url.removeprefix("https://s.example/") for r in crawler.crawl_site(spark, "https://s.example/", fetch, n).collect()}
    assert taken(3) == {"", "z", "y"} and taken(5) == {"", "z", "y", "a", "m"}
    began = time.time()
    assert crawler.crawl_site(spark, "https://s.example/", fetch, 1, delay=1.5).count() == 1 and time.time() - began > 1.5


def test_fetch_over_http():
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(2)
            self.send_response(302 if self.path == "/moved" else 200)
            self.send_header("Location", "/there")
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write("<p>é".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root, fetch = f"http://127.0.0.1:{server.server_port}", crawler.web_fetch(0.5)
        assert fetch(f"{root}/moved")["status"] == 302 and fetch(f"{root}/moved")["location"] == "/there"
        assert fetch(f"{root}/a?b=1")["html"] == "<p>é"
        with pytest.raises(TimeoutError):
            fetch(f"{root}/slow")
    finally:
        server.shutdown()


def test_workbook_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SHEET_ROWS", 4)
    rows = spark.createDataFrame([(i, f"<a & b>\x01 {i}", [i], None) for i in range(7)], "n int, t string, l array<int>, e string").coalesce(1)
    path = f"{tmp_path}/report.xlsx"
    assert files.write_workbook({"All: rows": rows, "None": rows.where("false"), "One": rows.limit(1)}, path) == ["All: rows", "One"]
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as book:
        names = [e.get("name") for e in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")]
        sheets = [ET.fromstring(book.read(f"xl/worksheets/sheet{i + 1}.xml")) for i in range(len(names))]
        assert all(ET.fromstring(book.read(n)) is not None for n in book.namelist())
    assert names == ["All  rows", "All  rows 2", "All  rows 3", "One"]
    texts = [["".join(c.itertext()) for c in row] for sheet in sheets for row in sheet.iter(f"{main}row")]
    assert texts[:2] == [["n", "t", "l", "e"], ["0", "<a & b> 0", "[0]", ""]] and len(texts) == 7 + 1 + 4


def test_sitemaps(spark):
    good = (
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:x="http://www.w3.org/1999/xhtml">'
        '<url><loc> https://s.example/a </loc><x:link rel="alternate" hreflang="FR" href="https://s.example/f"/></url></urlset>'
    )
    found = spark.createDataFrame([("1", good), ("2", "<broken")], "path string, text string")
    urls, links = context.sitemap_tables(found)
    assert [r.url for r in urls.collect()] == ["https://s.example/a"]
    assert [tuple(r) for r in links.collect()] == [("https://s.example/a", "fr", "https://s.example/f")]
    row = context.site_context(spark, "https://s.example/x", "Sitemap: https://s.example/m.xml", "<broken").first()
    assert row.sitemap_url == "https://s.example/m.xml" and row.sitemap_found and row.sitemap_valid is False
    assert context.site_context(spark, "https://s.example/x").first().sitemap_url == "https://s.example/sitemap.xml"


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", [1, 2], 'x "y", z')], "k string, v array<int>, t string")
    files.write_csv(frame, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.v == "[1,2]" and back.t == 'x "y", z'
    done = files.write_workbook({"Crawl Results": frame, "Empty": frame.where("false")}, str(tmp_path / "book"))
    assert done == ["Crawl Results"] and spark.read.parquet(str(tmp_path / "book/crawl_results")).count() == 1
    catalog = pd.DataFrame([["C001", "Links", "a, b", "Error", "Site", "New", None]], columns=["check_id", "category", "check_name", "severity", "level", "status", "notes"])
    catalog.to_csv(tmp_path / "catalog.csv", index=False)
    row = files.read_catalog(spark, str(tmp_path / "catalog.csv")).first()
    assert row.check_name == "a, b" and row.notes == ""


def test_display(spark):
    frame = spark.createDataFrame([("x" * 12, "y", 1)], "a string, html string, n int")
    row = pages.for_display(frame, drop=["html"], most_chars=10).first()
    assert row.a == "x" * 10 + "… [truncated]" and row.n == 1 and "html" not in row
    assert set(pages.with_optional_columns(frame).columns) >= set(pages.OPTIONAL)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).write.parquet(folder)
    query = stream_flags(page_stream(spark, folder)).writeStream.format("memory").queryName("flags").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = site(pages.crawl_table(spark.read.parquet(folder)).withColumn("crawl_status", F_lit("Failed")))
    wanted = [c for c in health.checks() if c.per_page and c.check_id != "C014"]
    assert spark.table("flags").where("check_id <> 'C014'").count() == health.page_flags(batch.crawl, wanted).count()
    counts = []
    query = each_batch(page_stream(spark, folder), lambda crawl, n: counts.append(crawl.count()), str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert counts == [20]


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_trend(spark):
    history = spark.createDataFrame([("s", 1, 50), ("s", 2, 60), ("t", 1, 70)], "site string, audit_ts long, health_score int")
    got = {(r.site, r.audit_ts): r.change for r in health.trend(history).collect()}
    assert got == {("s", 1): None, ("s", 2): 10, ("t", 1): None}
