"""Quantiles of groups: exact ones by counted ranges, and sketches that merge.

``exact_quantiles`` never brings a group's values together. Equal values of a group are counted
where they lie, the counts are put in order over all groups by ranges, and written; a range is
one task's share whatever the groups' sizes. Sums per group and range, a small table, tell which
range holds a wanted rank, and only those ranges are looked into.

``sketches`` and ``sketch_quantiles`` keep one value per group (KLL sketches), which add up over
days, tasks and tables; ``RANK_ERROR`` bounds how far a result's rank is off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialised

#: A sketch's parameter (it holds a few times as many values), and a bound of the rank error, about five times what the sketch keeps in 99 % of cases.
SKETCH_K, RANK_ERROR = 2000, 0.007


def exact_quantiles(frame: DataFrame, keys: list[str], value: str, share: float = 0.5, name: str = "quantile") -> DataFrame:
    """keys, ``name``, n: each group's quantile, between the two nearest values where the rank falls between; nulls don't count.

    Null keys are a group. A group without values gives no row. Values are ordered as Spark
    orders them: NaN is the largest.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share is between 0 and 1")
    own = [f"_k{i}" for i in range(len(keys))]
    plain = frame.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(value).alias("_value")).where("_value IS NOT NULL")
    counted = plain.groupBy(*own, "_value").agg(F.count("*").alias("_n"))
    ranged = counted.repartitionByRange(*own, "_value").withColumn("_range", F.spark_partition_id())
    ranged = materialised(frame.sparkSession, ranged, "ranges")
    # A row per group and range.
    order = Window.partitionBy(*own).orderBy("_range")
    sums = ranged.groupBy(*own, "_range").agg(F.sum("_n").alias("_in"))
    sums = sums.withColumn("_before", F.sum("_in").over(order) - F.col("_in")).withColumn("_all", F.sum("_in").over(Window.partitionBy(*own)))
    # Ranks from 0 of the two values around the quantile.
    exact = (F.col("_all") - 1) * F.lit(share)
    low, high = F.floor(exact), F.ceil(exact)
    holds = lambda rank, start, size: (rank >= start) & (rank < start + size)
    wanted = sums.where(holds(low, F.col("_before"), F.col("_in")) | holds(high, F.col("_before"), F.col("_in")))
    wanted = wanted.select(*[F.col(o).alias(f"{o}w") for o in own], F.col("_range").alias("_rangew"), "_before", "_all")
    same = [F.col(o).eqNullSafe(F.col(f"{o}w")) for o in own] + [F.col("_range") == F.col("_rangew")]
    inside = ranged.join(wanted, same).select(*own, "_value", "_n", "_range", "_before", "_all")
    place = Window.partitionBy(*own, "_range").orderBy("_value")
    start = F.col("_before") + F.sum("_n").over(place) - F.col("_n")
    placed = inside.withColumn("_start", start)
    at = lambda rank: F.max(F.when(holds(rank, F.col("_start"), F.col("_n")), F.col("_value")))
    found = placed.groupBy(*own).agg(at(low).alias("_low"), at(high).alias("_high"), F.first("_all").alias("_all"))
    part = exact - low
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(F.col("_low") * (1 - part) + F.col("_high") * part)
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], between.alias(name), F.col("_all").alias("n"))


def sketches(frame: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """keys, sketch: a mergeable sketch of each group's values; nulls and NaN don't count."""
    number = F.col(value).cast("double")
    return frame.select(*keys, F.when(~F.isnan(number), number).alias("_value")).groupBy(*keys).agg(F.kll_sketch_agg_double("_value", k).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of finer groups, or of several days, as sketches of ``keys``."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(made: DataFrame, keys: list[str], share: float = 0.75, name: str = "quantile") -> DataFrame:
    """keys, ``name``, n: quantiles of sketches, within RANK_ERROR of the rank."""
    n = F.kll_sketch_get_n_double("sketch")
    value = F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
    return made.select(*keys, value.alias(name), n.alias("n"))
