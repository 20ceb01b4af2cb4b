"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 50


def test_library_does_not_import_the_optional_part():
    from pathlib import Path

    root = Path(entry.__file__).parent / "crawlsight"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text().replace("fillm", ""), path
