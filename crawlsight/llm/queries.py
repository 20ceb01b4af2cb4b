"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, exact_dedup, line_dedup, lm_scoring, minhash_dedup, mixing, packing, pii, quality, source_divergence, suffix_dedup, topk
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_table(spark, sf_dir, "documents")).drop("spans")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


#: The conversation beside the table's own: control strings as text.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents")).drop("source")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_table(spark, sf_dir, "documents")).drop("removed_lines")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the counts of all others."""
    scored = lm_scoring.scores(_table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults set by a hash of conv_id and turn; nulls become one blank."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("fault")
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    hit = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return hit.select("conv_id", "turn", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hit = damaged(conversations)
    space = Workspace(spark, "conversation-repair")
    planned = space.write(conversation_repair.plans(hit), "plans")
    repaired = conversation_repair.repaired_digests(hit, planned)
    ids = conversations.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(repaired[c], zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(repaired, ids["conv_id"].eqNullSafe(repaired["conv_id"]), "left").select(
        ids["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_quality,
        op3_chat,
        op4_packing,
        op5_minhash_dedup,
        op6_mixing,
        op7_exact_dedup,
        op8_line_dedup,
        op9_lm_scoring,
        op10_top_k,
        op11_conversation_repair,
        op12_pii,
        op13_source_divergence,
    )
}
