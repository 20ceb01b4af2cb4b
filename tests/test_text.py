"""Text measures, keywords and terms on small examples."""

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import text as T
from crawlsight.plans import keywords, organic


def analysed(spark, text, target=""):
    frame = spark.createDataFrame([(text,)], "t string").select(T.squeezed(F.col("t")).alias("t"))
    return frame.select(*[c.alias(n) for n, c in T.analyse(F.col("t"), target).items()]).first()


def test_readability(spark):
    row = analysed(spark, "Hello   world. Bye!", "WORLD ")
    assert (row.word_count, row.sentence_count, row.paragraph_count, row.target_keyword_count) == (3, 2, 1, 1)
    assert row.syllable_count == 2 + 1 + 1 and row.avg_sentence_length == 1.5 and row.reading_time_minutes == 1
    assert row.flesch_reading_ease == round(206.835 - 1.015 * 1.5 - 84.6 * 4 / 3, 1)


def test_readability_of_nothing(spark):
    row = analysed(spark, None)
    assert (row.word_count, row.sentence_count, row.paragraph_count, row.flesch_reading_ease) == (0, 1, 0, 0.0)
    assert analysed(spark, "tree").syllable_count == 1 and analysed(spark, "wanted houses").syllable_count == 2


def test_keyword_frequency_ties(spark):
    rows = [(0, i, k) for i, k in enumerate(["b", "a", "a", "b", "c"])]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, keyword string")
    got = keywords.frequency(frame, 2).orderBy("place").collect()
    assert [(r.keyword, r.frequency, r.percentage) for r in got] == [("b", 2, 40.0), ("a", 2, 40.0)]
    assert keywords.frequency(frame.where("false")).count() == 0


def test_keyword_clusters(spark):
    rows = [("plant", 1), ("planet", 2), ("zzz", 3), ("net", 4)]
    got = keywords.clusters(spark.createDataFrame(rows, "keyword string, place int")).collect()
    assert [(r.leader, r.member) for r in sorted(got, key=lambda r: (r.leader, r.ord))] == [("net", "net"), ("net", "planet")]


@pytest.mark.parametrize(
    "word, intent", [("how to buy", "Informational"), ("buy", "Transactional"), ("Login", "Navigational"), ("apple", "Navigational"), ("tree", "Mixed")]
)
def test_keyword_intent(spark, word, intent):
    assert spark.createDataFrame([(word,)], "w string").select(T.keyword_intent(F.col("w"))).first()[0] == intent


def test_variations(spark):
    got = spark.createDataFrame([("tree",), ("trees",)], "w string").select(T.variations(F.col("w")).alias("v")).collect()
    assert len(got[0].v) == 9 and got[0].v[:2] == ["tree", "trees"] and len(got[1].v) == 8


def test_terms(spark):
    docs = spark.createDataFrame([(1, "The red tree. red tree!"), (2, "the of"), (3, None)], "doc_id long, text string")
    ranked = organic.tf_idf(docs, "doc_id", "text")
    assert {r.term for r in ranked.collect()} == {"red", "tree", "red tree", "tree red"}
    got = {r.doc_id: r for r in organic.candidates(docs, "doc_id", "text").collect()}
    assert got[1].top_terms.split(", ")[0] == "red" and got[2].keywords == [] and got[3].top_term_intent == "unknown"
    assert sum(t.score**2 for t in got[1].keywords) == pytest.approx(1)
