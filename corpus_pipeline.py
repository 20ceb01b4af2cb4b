"""A training corpus from raw documents: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, documents, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents, whatever their names and values.

Null texts are empty, to every stage. An empty text scores by the classifier's bias, is a
copy of other empty texts, has no near copies, takes no words in the mix (which leaves it
out), and packs as the terminator alone. Repeated rows and rows that share a doc_id are
rows of their own but for the copies that dedup drops; of rows with equal doc_id and text
one stays. Rows without doc_id may stay, and go to near dedup as rows that link with
nothing. Ties are settled by doc_id, then by a hash of all columns, so results don't depend
on the partitioning (but for the order of packed sequences). A very long text is one row to
every stage and is cut by packing only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlsight.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from crawlsight.llm.workspace import Workspace


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8."""
    return minhash_dedup.drop_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack_sequences(docs, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces made from all documents; each stage's result is written and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
