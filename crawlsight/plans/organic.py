"""Organic keyword candidates: TF-IDF over one- and two-word terms, intents, global terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import materialised

#: Terms of the vocabulary at most; those with the highest corpus frequency are kept.
MAX_TERMS = 10_000
#: Words of documents whose counts a task holds at once (of one document at least).
LOT_WORDS = 200_000


def corpus(crawl: DataFrame) -> DataFrame:
    """(url, doc_text): title, description, first heading and body of each page."""
    description = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("og_description"))
    return crawl.select("url", F.trim(F.concat_ws(" ", "title", description, "h1", "h.body_text")).alias("doc_text"))


def terms(documents: DataFrame, key: str, text: str, stop_words: list[str] = T.STOP_WORDS, words: int = 2) -> DataFrame:
    """(key, term, tf): counts of runs of up to ``words`` words after stop words are gone, made within each row; keys are unique."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w[\w\-]+\b"), F.lit(0))
    kept = documents.select(key, F.filter(found, lambda w: ~w.isin(stop_words)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                rows, found, counts = [], [], []
                for row, w in enumerate(lot.column("w").to_pylist()):
                    tf = Counter(w)
                    for n in range(2, words + 1):
                        tf.update(map(" ".join, zip(*(w[at:] for at in range(n)))))
                    rows += [row] * len(tf)
                    found += tf.keys()
                    counts += tf.values()
                keys = lot.column(key).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=[key, "term", "tf"])

    return kept.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, term string, tf long")


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in lots of bounded words."""
    begin = held = 0
    for at, size in enumerate(pc.list_value_length(batch.column("w")).to_pylist()):
        if at > begin and held + size > LOT_WORDS:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def tf_idf(documents: DataFrame, key: str = "url", text: str = "doc_text", top: int = 10, max_terms: int = MAX_TERMS, stop_words: list[str] = T.STOP_WORDS) -> DataFrame:
    """(key, term, score, place): each document's best terms.

    score = tf * (ln((1 + n) / (1 + df)) + 1), with rows of unit length. The
    vocabulary is bounded by ``max_terms``, so it is broadcast.
    """
    # Written, because both the vocabulary and the weights come from it: texts are tokenised once.
    counted = materialised(documents.sparkSession, terms(documents, key, text, stop_words), "terms")
    n = documents.agg(F.count("*").alias("n"))
    vocabulary = (
        counted.groupBy("term")
        .agg(F.sum("tf").alias("corpus_tf"), F.count("*").alias("df"))
        .orderBy(F.desc("corpus_tf"), "term")
        .limit(max_terms)
        .join(F.broadcast(n))
        .select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    weighted = counted.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    whole = Window.partitionBy(key)
    scored = weighted.withColumn("score", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    place = F.row_number().over(whole.orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select(key, "term", "score", "place")


def candidates(documents: DataFrame, key: str = "url", text: str = "doc_text", top: int = 10) -> DataFrame:
    """(key, keywords, top_terms, top_term_intent) of every document, also of those without terms."""
    ranked = tf_idf(documents, key, text, top).withColumn("intent", T.term_intent(F.col("term")))
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "term", "score"))).alias("listed"))
    votes = ranked.groupBy(key, "intent").agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    winner = votes.groupBy(key).agg(F.max_by("intent", F.struct("n", -F.col("seen"))).alias("intent"))
    none = F.array().cast("array<struct<term:string,score:double>>")
    return (
        documents.select(key)
        .join(listed, key, "left")
        .join(winner, key, "left")
        .select(
            key,
            F.coalesce(F.transform("listed", lambda t: F.struct(t["term"].alias("term"), t["score"].alias("score"))), none).alias("keywords"),
            F.coalesce(F.array_join(F.transform("listed", lambda t: t["term"]), ", "), F.lit("")).alias("top_terms"),
            F.coalesce("intent", F.lit("unknown")).alias("top_term_intent"),
        )
    )


def global_terms(ranked: DataFrame, top: int = 50) -> DataFrame:
    """(term, aggregate_score): the documents' best terms added up."""
    summed = ranked.groupBy("term").agg(F.sum("score").alias("aggregate_score"))
    return summed.orderBy(F.desc("aggregate_score"), "term").limit(top)
