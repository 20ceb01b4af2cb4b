"""Cases that reviews found: cut-off tags, bare references, pages that share a URL, large pages."""

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import html as H
from crawlsight.plans import health
from crawlsight.queries import QUERIES
from crawlsight.schemas import EXCERPT_CHARS, TRUNCATED
from crawlsight.sources import demo
from crawlsight.sources.audits import AuditStore
from crawlsight.sources.pages import crawl_table
from crawlsight.operators import tables


def test_a_tag_that_the_excerpt_cuts_off_joins_the_text_before_it():
    text = "<p>" + "x" * (EXCERPT_CHARS - 5)
    _, marks = H.parse_page("https://a.example/", text + "</p><p>more</p>")
    assert marks["body_text"] == "x" * (EXCERPT_CHARS - 5) + "</" + TRUNCATED


def test_bare_references_are_a_choice():
    page = "<title>a&amp;&amp</title><script>x&amp</script><p>b &copy; &am</p>"
    assert H.parse_page("u", page)[0]["title"] == "a&&"
    plain, _ = H.parse_page("u", page, bare_references=False)
    assert plain["title"] == "a&&amp" and plain["content_text"] == "a&&amp b © &am"


def test_elements_are_counted_in_the_whole_page():
    _, marks = H.parse_page("u", "<i></i>" * (EXCERPT_CHARS // 7 + 500))
    assert marks["n_tags"] == EXCERPT_CHARS // 7 + 500


def test_a_task_holds_a_lot_of_pages(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"html": ["x" * (H.LOT_CHARS // 4)] * 9 + [None] * (H.LOT_PAGES + 1)})
    lots = [lot.num_rows for lot in H.page_lots(batch)]
    assert lots == [4, 4, H.LOT_PAGES, 2] and sum(lots) == batch.num_rows


def test_pages_that_share_a_url_are_each_judged(spark):
    rows = [("https://a.example/x", "<title>one</title>"), ("https://a.example/x", "<title>one</title>"), ("https://a.example/y/", "")]
    crawl = crawl_table(spark.createDataFrame(rows, "url string, html string"))
    found = health.flags(tables.site(crawl), [c for c in health.checks() if c.check_id in ("C037", "C041", "C044")])
    assert sorted(map(tuple, found.collect())) == [
        ("C037", rows[0][0]), ("C037", rows[0][0]), ("C041", rows[2][0]), ("C044", rows[0][0]), ("C044", rows[0][0])
    ]


def test_stored_pages_that_share_a_url_are_told_apart_by_id(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>"), (3, "v", "c")], "page_id long, url string, html string")
    store = AuditStore(spark, f"file://{tmp_path}/store", "page_id")
    first = store.add(pages.where("page_id < 3"))
    second = store.add(pages.where("page_id > 1").withColumn("html", F.when(F.col("page_id") == 2, "<p>new words</p>").otherwise(F.col("html"))))
    assert sorted(map(tuple, store.changes(first, second).collect())) == [(1, "gone"), (2, "changed"), (3, "added")]
    assert sorted(map(tuple, store.crawl(second).select("page_id", "url", "word_count").collect())) == [(2, "u", 2), (3, "v", 1)]


def test_anti_join_leaves_customers_without_any_order(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 5.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in QUERIES["rel_anti_join"](spark, str(tmp_path)).collect()] == [2]


def test_derived_rows_are_dealt_to_as_many_tasks_as_their_pages_need(spark, monkeypatch):
    monkeypatch.setattr(demo, "ROWS_A_TASK", 100)
    rows = demo.numbered(spark.range(1000).withColumnRenamed("id", "page_id"))
    assert rows.rdd.getNumPartitions() == 10
    assert sorted(r.i for r in rows.collect()) == list(range(1000))


def test_the_derived_crawl_is_parsed_by_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(demo, "ROWS_A_TASK", 25)
    crawl = demo.demo_site(spark, spark.range(200).withColumnRenamed("id", "page_id")).crawl
    held = [spark.read.parquet(f).count() for f in crawl.inputFiles()]  # a task writes a file
    assert len(held) == 8 and sum(held) == 200 and max(held) <= 2 * 25


def test_terms_count_words_and_pairs_in_lots(spark, monkeypatch):
    from crawlsight.plans import organic

    docs = spark.createDataFrame([(1, "red kite red kite"), (2, None), (3, "blue")], "doc_id long, text string")
    found = organic.terms(docs, "doc_id", "text").collect()
    assert sorted(map(tuple, found)) == [(1, "kite", 2), (1, "kite red", 1), (1, "red", 2), (1, "red kite", 2), (3, "blue", 1)]
    import pyarrow as pa

    monkeypatch.setattr(organic, "LOT_WORDS", 4)
    batch = pa.RecordBatch.from_pydict({"w": [["a"] * 3, ["a"], ["a"], ["a"] * 9, []]})
    assert [lot.num_rows for lot in organic._lots(batch)] == [2, 1, 1, 1]


def test_totals_read_texts_once(spark):
    from crawlsight.plans import keywords

    docs = spark.createDataFrame([(1, "red kite red"), (2, "kite blue")], "doc_id long, text string")
    found = keywords.totals(keywords.extracted(docs))
    assert found.first().asDict() == {"total_keywords": 5, "unique_keywords": 3}
    assert "Expand" not in found._jdf.queryExecution().toString()  # a distinct count beside another would double the rows


def test_language_is_told_as_before(spark):
    from crawlsight.operators.international import detected_language

    texts = [("le la de et les des est que pour dans " * 3,), ("the and of " * 9,), ("the and of",), ("zzz " * 30,), (None,)]
    found = spark.createDataFrame(texts, "t string").select(detected_language(F.col("t"))["language"].alias("l")).collect()
    assert [r.l for r in found] == ["fr", "en", None, None, None]


def test_a_parse_makes_only_what_is_asked_for(spark):
    rows = [("https://a.example/x", "<title>one</title><p>two words</p><a href='/y'>three</a>", 7), ("https://a.example/y", None, 8)]
    pages = spark.createDataFrame(rows, "url string, html string, page_id long")
    whole = H.parse_pages(pages)
    some = H.parse_pages(pages, only=["links", "url", "word_count"])
    assert some.columns == ["url", "word_count", "links"]
    assert some.collect() == whole.select(*some.columns).collect()
    assert H.parse_pages(pages, only=["page_id", "h"]).collect() == whole.select("page_id", "h").collect()
    assert H.parse_page(rows[0][0], rows[0][1], markup=False) == (H.parse_page(rows[0][0], rows[0][1])[0], {})
    with pytest.raises(ValueError, match="colour"):
        H.parse_pages(pages, only=["colour"])


@pytest.mark.parametrize("text", ["", '""', '"', "a,\"b\0c\"", '\0"', "\\\"", "a\r\nb\r", "\n", " a ", "#x", None])
def test_csv_gives_back_texts_as_they_were(spark, tmp_path, text):
    from crawlsight.sources import files

    rows = [(text, 1, text, "x"), ("x", 2, text, None), (None, None, "", text)]
    schema = "a string, k long, b string, c string"
    files.write_csv(spark.createDataFrame(rows, schema).coalesce(1), f"file://{tmp_path}/csv")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/csv", schema).collect()] == rows


def test_csv_round_trip_of_empty_and_quoted_documents_is_as_its_sql_says(spark, tmp_path):
    from oracle import TABLES, check

    from crawlsight.oracles import ORACLE_SQL

    texts = [(1, "", "en"), (2, 'say "\0"', ""), (3, None, None), (4, "plain", "de")]
    for name in TABLES:  # the SQL's views name them all
        spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    check(spark, QUERIES["csv_round_trip"], ORACLE_SQL["csv_round_trip"], str(tmp_path))


#: Queries on the derived site whose checks looked at the first 12,000 characters of a page alone.
WHOLE_PAGES = """checks_architecture checks_extra checks_international checks_markup checks_mobile checks_performance checks_security
    health_categories health_findings health_quick_wins low_inlinks repeated_dead_link_pages site_inbound_links""".split()


@pytest.mark.parametrize("name", WHOLE_PAGES)
def test_checks_look_at_what_comes_late_in_a_page(spark, monkeypatch, name):
    """Every page begins with a comment longer than the excerpt; the SQL says so, too, and is else as it was."""
    from conftest import MEDIUM
    from oracle import check

    from crawlsight.oracles import ORACLE_SQL

    html = demo.html_sql()
    late = f"concat('<!--', repeat('x', {EXCERPT_CHARS}), '-->', {html})"
    monkeypatch.setattr(demo, "html_sql", lambda: late)
    assert html in ORACLE_SQL[name]
    check(spark, QUERIES[name], ORACLE_SQL[name].replace(html, late), MEDIUM)


def test_an_excerpt_is_looked_at_where_it_is_asked_for(spark):
    html = "<p>" + "x" * EXCERPT_CHARS + "</p><h1>late</h1>"
    pages = spark.createDataFrame([("https://a.example/x", html)], "url string, html string")
    levels = lambda **options: crawl_table(pages, **options).first().h.levels
    assert levels() == [1] and levels(excerpt_chars=EXCERPT_CHARS) == [] and levels(excerpt_chars=2 * EXCERPT_CHARS) == [1]
    assert crawl_table(pages, excerpt_chars=EXCERPT_CHARS).first().html == html


def test_the_corpus_holds_whole_pages(spark, tmp_path):
    html = "<title>t</title><h1>h</h1><p>" + "x " * EXCERPT_CHARS + "last</p>"
    spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = spark.range(1).select(F.sha1(F.lit("t  h t h " + "x " * EXCERPT_CHARS + "last"))).first()[0]
    assert [r.text_sha1 for r in QUERIES["page_corpus"](spark, str(tmp_path)).collect()] == [want]
