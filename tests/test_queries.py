"""Every library query against its SQL."""

import pytest
from conftest import MEDIUM, SMALL
from oracle import check

from crawlsight.oracles import CHECK_SQL, ORACLE_SQL
from crawlsight.plans.health import EVALUATION_ORDER, checks
from crawlsight.queries import QUERIES
from crawlsight.sources.demo import numbered

def test_names():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert [c.check_id for c in checks()] == sorted(EVALUATION_ORDER)
    assert len(checks()) == 121
    assert {c.check_id for c in checks()} <= set(CHECK_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name], MEDIUM)


def test_body_text_of_every_page(spark):
    long = spark.read.parquet(f"{MEDIUM}/pages.parquet").where("length(html) > 12000")
    assert long.join(QUERIES["page_body_text"](spark, MEDIUM), "page_id").count() == long.count() > 0


def test_rows_are_numbered_in_order(spark):
    pages = spark.range(5000).selectExpr("id * 7919 % 5003 AS page_id").repartition(6)
    found = sorted((r.i, r.n) for r in numbered(pages).collect())
    assert found == [(i, 5000) for i in range(5000)]


def test_texts_and_pages_are_read_once(spark, capfd):
    """No query parses pages or tokenises texts in two places of one plan."""
    for name in ("page_duplicate_titles", "organic_terms", "keyword_frequency"):
        QUERIES[name](spark, SMALL).explain()
        plan = capfd.readouterr().out
        assert "MapInPandas" not in plan and "regexp_extract_all" not in plan, name
