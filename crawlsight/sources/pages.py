"""From raw pages to the crawl table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.html import parse_pages
from ..schemas import EXCERPT_CHARS, FETCHED, TRUNCATED

#: Columns that a foreign result table may lack, and what stands for them.
OPTIONAL = {
    "heading_count": 0,
    "image_count": 0,
    "link_to_word_ratio": 0.0,
    "canonical_url": "",
    "og_title": "",
    "og_description": "",
}


def fetched(pages: DataFrame) -> DataFrame:
    """Raw pages (url, html) as successful fetches: missing columns of FETCHED become null or a plain success."""
    out = pages
    for field in StructType.fromDDL(FETCHED).fields:
        if field.name not in out.columns:
            plain = {"status": "200", "crawl_status": "Success", "mime_type": "text/html", "crawl_time_s": 0.0}
            out = out.withColumn(field.name, F.lit(plain.get(field.name)).cast(field.dataType))
    return out


def crawl_table(pages: DataFrame, bare_references: bool = True, only: list[str] | None = None, excerpt_chars: int | None = None) -> DataFrame:
    """The parsed crawl of fetched pages, or some of its columns. The only step that needs Python; it reads each page once.

    Checks look at whole pages, or with ``excerpt_chars`` at excerpts; ``html`` stays whole, unless ``stored_html`` cuts it.
    """
    return parse_pages(fetched(pages), bare_references, only, excerpt_chars)


def with_optional_columns(crawl: DataFrame) -> DataFrame:
    """A result table with the optional columns that it lacks."""
    return crawl.withColumns({c: F.lit(v) for c, v in OPTIONAL.items() if c not in crawl.columns})


def for_display(frame: DataFrame, drop: list[str] | None = None, most_chars: int = 8000) -> DataFrame:
    """Without the dropped columns, and with long texts cut and marked."""
    kept = [f for f in frame.schema.fields if f.name not in (drop or [])]
    cut = lambda c: F.when(F.length(c) > most_chars, F.concat(F.substring(c, 1, most_chars), F.lit(TRUNCATED))).otherwise(F.col(c))
    return frame.select(*[cut(f.name).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in kept])


def stored_html(frame: DataFrame) -> DataFrame:
    """Pages with their HTML cut to the excerpt that a result table keeps."""
    return frame.withColumn(
        "html",
        F.when(F.length("html") > EXCERPT_CHARS, F.concat(F.substring("html", 1, EXCERPT_CHARS), F.lit(TRUNCATED))).otherwise(F.col("html")),
    )

