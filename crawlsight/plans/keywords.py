"""Keyword research: frequencies, intents, opportunities, difficulty and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import materialised
from .clusters import clusters


def extracted(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, keyword) of all texts; a keyword's position decides ties of first occurrence."""
    return documents.select(key, F.posexplode(T.keywords(F.col(text))).alias("pos", "keyword"))


def counted(keywords: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(keyword, frequency, seen) of all keywords, written: texts are tokenised once.

    ``first`` names the columns whose order decides ties; counts and first places are
    pre-aggregated.
    """
    order = F.struct(*(first or ["pos"]))
    counts = keywords.groupBy("keyword").agg(F.count("*").alias("frequency"), F.min(order).alias("seen"))
    return materialised(keywords.sparkSession, counts, "keywords")


def totals(keywords: DataFrame) -> DataFrame:
    """One row: how many keywords there are, and how many different ones; texts are tokenised once and keywords counted before they move."""
    counts = keywords.groupBy("keyword").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_keywords"), F.count("*").alias("unique_keywords"))


def frequency(keywords: DataFrame, top: int = 20, first: list[str] | None = None) -> DataFrame:
    """(keyword, frequency, percentage, place) of the most frequent keywords; only they are sorted in one place."""
    counts = counted(keywords, first)
    total = counts.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total"))
    best = counts.orderBy(F.desc("frequency"), "seen").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("frequency"), "seen"))
    return best.join(F.broadcast(total)).select(
        "keyword",
        "frequency",
        F.round(F.col("frequency") / F.col("total") * 100, 2).alias("percentage"),
        place.alias("place"),
        "total",
    )


def per_document(documents: DataFrame, words: Column, key: str = "doc_id", top: int = 10) -> DataFrame:
    """(key, keyword, frequency, place): each document's most frequent words, the first seen of equal ones; nothing is shuffled."""
    counted = T.with_counts(documents.select(key, words.alias("words")), "words", "counts")
    ranked = F.sort_array(F.transform("counts", lambda c: F.struct((-c["n"]).alias("n"), c["seen"].alias("seen"), c["word"].alias("word"))))
    best = counted.select(key, F.posexplode_outer(F.slice(ranked, 1, top)).alias("at", "c")).where("c IS NOT NULL")
    return best.select(key, F.col("c.word").alias("keyword"), (-F.col("c.n")).alias("frequency"), (F.col("at") + 1).alias("place"))


def intents(ranked: DataFrame) -> DataFrame:
    """(keyword, intent)."""
    return ranked.select("keyword", T.keyword_intent(F.col("keyword")).alias("intent"))


def intent_summary(ranked: DataFrame) -> DataFrame:
    """(intent, count, percentage)."""
    counted = intents(ranked).groupBy("intent").agg(F.count("*").alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy()) * 100
    return counted.select("intent", "count", F.round(share, 1).alias("percentage"))


def opportunities(ranked: DataFrame, rankings: int = 0) -> DataFrame:
    """The keywords' opportunity columns, best first."""
    columns = T.opportunity(F.col("keyword"), F.col("frequency"), F.col("total"), rankings)
    return ranked.select("keyword", *[c.alias(n) for n, c in columns.items()]).orderBy(F.desc("opportunity_score"), "keyword")


def difficulties(ranked: DataFrame) -> DataFrame:
    columns = T.difficulty(F.col("keyword"), F.col("frequency"), F.col("total"))
    return ranked.select("keyword", *[c.alias(n) for n, c in columns.items()])


def variations(ranked: DataFrame) -> DataFrame:
    """(keyword, pos, variation)."""
    return ranked.select("keyword", F.posexplode(T.variations(F.col("keyword"))).alias("pos", "variation"))


def report(keywords: DataFrame, top: int = 50, first: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the keyword report."""
    ranked = frequency(keywords, top, first)
    best = opportunities(ranked)
    return {
        "totals": totals(keywords),
        "frequency": ranked,
        "intents": intents(ranked),
        "intent_summary": intent_summary(ranked),
        "opportunities": best,
        "top_opportunities": best.limit(10),
        "clusters": clusters(ranked),
    }
