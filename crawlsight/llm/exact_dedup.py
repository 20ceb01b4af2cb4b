"""Exact dedup over an extendible-hash index in shared files (DataFrame operations only).

1. Every row is reduced to a digest (doc_id, 64-bit hash of the text, SHA-256),
   written once; the texts stay where they are. Entries (hash, rows) are
   pre-aggregated on the map side.
2. The directory starts with one bucket and doubles until no bucket holds more
   than ``bucket_rows`` entries: a bucket of depth d is the d leading bits of the
   hash. The doublings are evaluated at once, over counts of the cells that so
   many entries may need, so the depth has no cap; what a bucket of the last depth
   holds beyond its size is chained there.
3. The index is written in shared files, dealt to owners by key range. An entry
   with one row is done: its text is its own.
4. Other entries get their records: the texts, with the smallest doc_id and the
   number of rows, pre-aggregated by ``SALTS`` salts, so that a text with a billion
   copies becomes a few records. They are dealt to the owners of their bucket's key
   range and written as the bucket's overflow files.
5. An owner takes its buckets key by key, in order of text: a record whose bytes
   equal its predecessor's continues that link of the key's chain, any other opens a
   new link. A link's smallest doc_id stays; its rows are the group's.
6. Each row looks its link up. Hot links (over 1/1000 of all rows, so fewer than
   1000 of them) are broadcast; all others meet in a shuffle join where no key holds
   more than 1/1000 of the rows.

Texts are equal if identical after each run of ASCII white space becomes one
blank. Null texts count as empty; empty texts equal each other; very long texts are
compared whole; rows with the same doc_id and text are copies of each other; an
empty table gives an empty result; rows without doc_id sort after all others and may
only be kept if no copy has an id. Extra columns are ignored by ``exact_groups`` and
returned as they are by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import row_hash, squeezed, unused
from .workspace import Workspace

#: A text with more than one of so many rows is hot; so there are fewer hot texts than this.
HOT_SHARE = 1000
#: Records per text at most, before its owner adds them up.
SALTS = 16
#: Depths that the directory may need beyond an even spread of the hashes.
ROOM = 8
#: Bytes that are broadcast at most, and what a row of hashes or of (doc_id, digest) takes.
BROADCAST_BYTES, HASH_BYTES, ROW_BYTES = 16 << 20, 32, 128


def _leading(key: Column, bits: Column) -> Column:
    """The leading bits of a hash, as a number; no bits give 0."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (64 - bits).cast("int")))


def depth_limit(entries: int, bucket_rows: int) -> int:
    """The depth up to which the directory may double for so many entries."""
    return min(62, max(0, math.ceil(math.log2(max(1, entries / bucket_rows)))) + ROOM)


def directory(entries: DataFrame, bucket_rows: int, limit: int) -> DataFrame:
    """(cell, depth, bucket): the bucket of each of the directory's cells, the ``limit`` leading bits of a key."""
    cells = entries.groupBy(_leading(F.col("key"), F.lit(limit)).alias("cell")).agg(F.count("*").alias("held"))
    loads = cells.select("cell", "held", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("depth")).withColumn(
        "bucket", F.expr(f"shiftright(cell, {limit} - depth)")
    )
    fits = loads.groupBy("depth", "bucket").agg(F.sum("held").alias("total")).where((F.col("total") <= bucket_rows) | (F.col("depth") == limit))
    # A cell's bucket is the shallowest that fits: a split stops there.
    return (
        fits.select("depth", "bucket")
        .join(loads.select("cell", "depth", "bucket"), ["depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bucket")).alias("b"))
        .select("cell", "b.depth", "b.bucket")
    )


def build_index(digests: DataFrame, bucket_rows: int, space: Workspace) -> DataFrame:
    """(low, key, n): the index's entries in files by key range; ``low`` is where an entry's bucket begins."""
    entries = space.write(digests.groupBy("key").agg(F.count("*").alias("n")), "entries")
    total = entries.count()
    limit = depth_limit(total, bucket_rows)
    cells = space.write(directory(entries, bucket_rows, limit), "directory")
    if cells.count() * HASH_BYTES <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    owned = entries.withColumn("cell", _leading(F.col("key"), F.lit(limit))).join(cells, "cell")
    low = F.expr("CASE WHEN depth = 0 THEN 0 ELSE shiftleft(bucket, 63 - depth) END").cast("long")
    owners = max(-(-total // bucket_rows), _partitions(digests))
    # The key without its last bit, as a number that is not negative, is in the buckets' order.
    dealt = owned.select(low.alias("low"), "key", "n").repartitionByRange(owners, "low", F.expr("shiftrightunsigned(key, 1)"))
    return space.write(dealt.sortWithinPartitions("low", F.expr("shiftrightunsigned(key, 1)")), "index")


def resolve_chains(records: DataFrame, owners: int) -> DataFrame:
    """(key, sha, keep_id, group_size): the links of all chains, from records (low, key, norm, first, n).

    Records are dealt by key range, and a chain is put together where they arrive. A
    key has at most ``SALTS`` records per text.
    """
    dealt = records.repartitionByRange(owners, "low", "key")
    chain = Window.partitionBy("low", "key").orderBy("norm", F.col("first").asc_nulls_last(), "n")
    opens = ~F.lag("norm").over(chain).eqNullSafe(F.col("norm"))
    linked = dealt.withColumn("opens", opens).withColumn("link", F.sum(F.col("opens").cast("int")).over(chain))
    return (
        linked.groupBy("low", "key", "link")
        .agg(
            F.max(F.when(F.col("opens"), F.sha2("norm", 256))).alias("sha"),
            F.min("first").alias("keep_id"),
            F.sum("n").alias("group_size"),
        )
        .select("key", "sha", "keep_id", "group_size")
    )


def exact_groups(documents: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    keep_id is the smallest doc_id among equal texts.
    """
    space = Workspace(documents.sparkSession, "exact-dedup")
    texts = documents.select("doc_id", squeezed(F.col("text")).alias("norm"))
    digests = space.write(
        texts.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")), "digests"
    )
    rows = digests.count()
    index = build_index(digests, bucket_rows, space)
    repeated = space.write(index.where("n > 1").select("low", "key"), "repeated")
    n_repeated = repeated.count()
    if n_repeated * HASH_BYTES <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    records = (
        texts.withColumn("key", F.xxhash64("norm"))
        .join(repeated, "key")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .groupBy("low", "key", "norm", "salt")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .drop("salt")
    )
    owners = max(-(-n_repeated // bucket_rows), _partitions(documents))
    chains = space.write(resolve_chains(records, owners), "chains")
    hot = F.col("group_size") > F.lit(max(1, rows // HOT_SHARE))
    looked = digests.join(
        F.broadcast(chains.where(hot).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})),
        ["key", "sha"],
        "left",
    )
    found = looked.where("hot_size IS NOT NULL").select(
        "doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "sha"
    )
    rest = (
        looked.where("hot_size IS NULL")
        .join(chains.where(~hot), ["key", "sha"], "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            "sha",
        )
    )
    return found.unionByName(rest).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: one of each group of equal texts.

    Only the identities of the rows to drop are joined, so the texts move only
    if those take more than ``BROADCAST_BYTES``. Of rows that repeat both the doc_id
    and the text, the one with the smallest hash of all its columns stays.
    """
    columns = [f"`{c}`" for c in documents.columns]
    sha, gone_id, gone_sha, place, again_id, again_sha = unused(
        documents.columns, "sha", "gone_id", "gone_sha", "place", "again_id", "again_sha"
    )
    space = Workspace(documents.sparkSession, "exact-drop")
    groups = space.write(exact_groups(documents).select("doc_id", "text_sha256", "kept"), "groups")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    if gone.count() * ROW_BYTES <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    marked = documents.withColumn(sha, F.sha2(squeezed(F.col("text")), 256))
    left = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    again = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    again = space.write(again.select(F.col("doc_id").alias(again_id), F.col("text_sha256").alias(again_sha)), "again")
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col(again_id)) & (F.col(sha) == F.col(again_sha))
        order = Window.partitionBy("doc_id", sha).orderBy(row_hash(documents))
        several = left.join(again, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
        left = left.join(again, same, "left_anti").unionByName(several.drop(place))
    return left.select(*columns)


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
