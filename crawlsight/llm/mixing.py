"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Targets: the sources' weights share ``budget`` times the size of all documents.
A target stops at ``repeat_cap`` times its source's size; the excess is shared
again by weight until none is above. That is the level L with
sum(min(cap, weight * L)) = budget, read off the sources in the order of
cap / weight.

Quotas: the tokens are dealt in blocks of ``block_tokens``. A source gets blocks
by highest quotients target / (2k + 1), as long as it has blocks to give; the same
rule deals a source's blocks to its shards by shard size. Quotas that every divisor
between two bounds gives are taken as a lower bound, so that only about four
quotients per source or shard are ranked, whatever the number of blocks.

Selection: a shard's documents, in seeded order, form one circular stream of
tokens. Its quota is a run of consecutive blocks from a seeded start; a run
longer than the stream passes over it again, at most ``repeat_cap`` times in all.
The closed form of the overlap gives each document's share without exploding
anything. A source is cut into shards of about ``shard_tokens`` (at most
``MAX_SHARDS``), so a source that holds a third of all rows is no hot key.

Edge cases: null texts have size 0 and take nothing; a source of size 0 has
target 0; a null source is a source of its own, last in order; an empty table
gives an empty result; very long texts are documents like others, of which a run
may take a part; repeated rows and rows without doc_id count as documents of their
own, and neither they nor those with the same doc_id are taken twice for once;
extra columns are ignored by ``mix`` and returned as they are by
``mixed_documents``, whatever their names. Equal seeds give equal results whatever
the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import row_hash, unused, word_count
from .workspace import Workspace

#: Shards of one source at most; bounds the ranking of quotients within a source.
MAX_SHARDS = 4096
#: Bytes of copies that are broadcast at most, and bytes of one; beyond it the texts are shuffled.
BROADCAST_BYTES, COPY_BYTES = 16 << 20, 64


def _seeded(*parts: Column | str | int) -> Column:
    """A number from 0 to 2 ** 60 - 1 that a seed and some values give."""
    text = F.concat_ws("/", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, repeat_cap: float) -> DataFrame:
    """``sources`` (source, source_size) with its weight and target.

    The windows without a key run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
        .withColumn("cap", F.lit(repeat_cap) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(budget) * F.sum("source_size").over(Window.partitionBy()))
    )
    # The level if just the sources before this one are capped; none exceeds the true level and one equals it.
    levels = ranked.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    level = F.max("level").over(Window.partitionBy())
    return levels.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "source_size", "weight", "target")


def apportion(parts: DataFrame, key: list[str | Column], share: str, seats: str, most: str, out: str) -> DataFrame:
    """Add ``out``: Sainte-Lague seats of each row within its key.

    ``share`` holds the non-negative votes, ``seats`` the key's number of seats
    and ``most`` the seats that a row can take. Ties go to the smaller ``tie``
    column. Without rounding a row would have min(most, share * t), and rounding
    moves the sum of n rows by n / 2 at most. So the method's own level lies between
    those that hand out n / 2 seats less and more, which bound a row's seats.
    """
    whole = Window.partitionBy(*key)
    order = whole.orderBy("_ratio", "tie")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    votes = F.col(share).cast("double")

    def level(total: Column) -> Column:
        """With just the rows before one at their most; none exceeds the level of this total, and one equals it."""
        return (total - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.nullif(F.sum(votes).over(rest), F.lit(0.0))

    half = F.count("*").over(whole) / 2
    leveled = (
        parts.withColumn("_most", F.when(votes > 0, F.col(most).cast("double")).otherwise(F.lit(0.0)))
        .withColumn("_ratio", F.when(votes > 0, F.col("_most") / votes))
        .withColumn("_low", level(F.col(seats) - half))
        .withColumn("_high", level(F.col(seats) + half))
    )
    bounded = (
        leveled.withColumn("_low", F.greatest(F.lit(0.0), F.floor(votes * F.max("_low").over(whole) - 1)))
        .withColumn("_least", F.least("_low", "_most").cast("long"))
        .withColumn("_upto", F.least(F.ceil(votes * F.max("_high").over(whole) + 1), F.col("_most")).cast("long"))
        .withColumn("_open", (F.col(seats) - F.sum("_least").over(whole)).cast("long"))
    )
    quotients = (
        bounded.where("_upto > _least")
        .withColumn("_k", F.explode(F.sequence(F.col("_least"), F.col("_upto") - 1)))
        .withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(whole.orderBy(F.col("_quotient").desc(), "tie", "_k")))
        .where("_rank <= _open")
        .groupBy("tie")
        .agg(F.count("*").alias("_more"))
    )
    return (
        bounded.join(quotients, "tie", "left")
        .withColumn(out, F.col("_least") + F.coalesce("_more", F.lit(0)))
        .drop("_most", "_ratio", "_low", "_high", "_least", "_upto", "_open", "_more")
    )


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    repeat_cap: int = 2,
    block_tokens: int = 8,
    shard_tokens: int = 65_536,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per input row."""
    return _mixed(documents, weights, budget, repeat_cap, block_tokens, shard_tokens, seed).drop("row")


def _identity(documents: DataFrame) -> Column:
    """A hash of what a row's part in the mix rests on: rows that share it can stand for each other."""
    return F.xxhash64("doc_id", "source", "text")


def _mixed(
    documents: DataFrame, weights: tuple[int, ...], budget: float, repeat_cap: int, block_tokens: int, shard_tokens: int, seed: int
) -> DataFrame:
    """As ``mix``, with each row's identity in the column ``row``."""
    space = Workspace(documents.sparkSession, "mixing")
    sizes = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _identity(documents).alias("row"))
    sizes = space.write(sizes, "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = (
        source_targets(sources, weights, budget, float(repeat_cap))
        .withColumn(
            "shards",
            F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))).cast("int"),
        )
        .withColumn("most", F.floor(F.lit(repeat_cap) * F.col("source_size") / block_tokens))
        .withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_tokens).cast("long"))
        .withColumn("tie", _seeded(seed, "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    )
    quotas = space.write(
        apportion(targets, [], "target", "blocks", "most", "source_blocks").select(
            "source", "source_size", "target", "shards", "source_blocks", F.col("tie").alias("source_key")
        ),
        "quotas",
    )
    dealt = (
        sizes.join(quotas, sizes["source"].eqNullSafe(quotas["source"]))
        .withColumn("place", _seeded(seed, "place", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        # The low bits choose the shard, the others the place in its stream.
        .withColumn("shard", F.pmod(F.col("place"), F.col("shards")))
        .select("doc_id", sizes["source"], "size", "row", "source_key", "shard", F.shiftright("place", 16).alias("place"))
    )
    shards = (
        dealt.groupBy("source_key", "shard")
        .agg(F.sum("size").alias("shard_size"))
        .join(quotas, "source_key")
        .withColumn("most", F.floor(F.lit(repeat_cap) * F.col("shard_size") / block_tokens))
        .withColumn("tie", _seeded(seed, "shard", F.col("source_key"), F.col("shard")))
    )
    shards = apportion(shards, ["source_key"], "shard_size", "source_blocks", "most", "blocks")
    runs = space.write(
        shards.select(
            "source_key",
            "shard",
            "source_size",
            "target",
            "shard_size",
            (F.col("blocks") * block_tokens).alias("run"),
            (
                F.pmod(_seeded(seed, "start", F.col("tie")), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_tokens)))
                * block_tokens
            ).alias("start"),
        ),
        "runs",
    )
    stream = Window.partitionBy("source_key", "shard").orderBy("place", "doc_id", "size", "row")
    placed = dealt.withColumn(
        "from_", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    )
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("run") / F.col("shard_size"))).otherwise(F.lit(0))
    first, last = F.col("from_"), F.col("from_") + F.col("size")
    end = F.col("start") + F.col("run") - F.col("passes") * F.col("shard_size")
    overlap = F.greatest(F.lit(0), F.least(last, end) - F.greatest(first, F.col("start")))
    wrapped = F.greatest(F.lit(0), F.least(last, end - F.col("shard_size")) - first)
    return (
        placed.join(runs, ["source_key", "shard"])
        .withColumn("passes", whole)
        .withColumn("taken", (F.col("passes") * F.col("size") + overlap + wrapped).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "row")
    )


def mixed_documents(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    repeat_cap: int = 2,
    block_tokens: int = 8,
    shard_tokens: int = 65_536,
    seed: int = 0,
) -> DataFrame:
    """``documents`` with each row as often as the mix takes its words, rounded.

    Only the first and last document of a shard's run are taken in part, so the
    sources come near their targets. Documents that the mix doesn't take are gone.
    Rows with equal doc_id, source and text share their copies evenly; what is left
    over goes to those with the smallest hash of all columns.
    """
    columns = [f"`{c}`" for c in documents.columns]
    row, copy, own, rows, times, turn = unused(documents.columns, "row", "copy", "own", "rows", "times", "turn")
    mixed = _mixed(documents, weights, budget, repeat_cap, block_tokens, shard_tokens, seed)
    part = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    copies = mixed.groupBy(F.col("row").alias(own)).agg(F.count("*").alias(rows), F.sum(part).alias(times)).where(F.col(times) > 0)
    copies = Workspace(documents.sparkSession, "mixed").write(copies, "copies")
    uneven = copies.where(F.col(times) % F.col(rows) != 0)
    marked = documents.withColumn(row, _identity(documents))

    def joined(some: DataFrame) -> DataFrame:
        side = F.broadcast(some) if some.count() * COPY_BYTES <= BROADCAST_BYTES else some
        return marked.join(side, F.col(row) == F.col(own))

    each = F.expr(f"`{times}` DIV `{rows}`")
    if uneven.isEmpty():
        found = joined(copies).withColumn(copy, each)
    else:
        order = Window.partitionBy(row).orderBy(row_hash(documents))
        even = joined(copies.where((F.col(times) % F.col(rows) == 0))).withColumn(copy, each)
        ranked = joined(uneven).withColumn(turn, F.row_number().over(order))
        more = F.when(F.col(turn) <= F.col(times) % F.col(rows), F.lit(1)).otherwise(F.lit(0))
        found = even.unionByName(ranked.withColumn(copy, each + more).drop(turn))
    return found.where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select(*columns)
