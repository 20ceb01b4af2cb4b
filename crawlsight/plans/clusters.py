"""Greedy clusters of keywords by shared characters, over any number of keywords.

The greedy rule: keywords become leaders in sorted order, and a leader takes every keyword that
is still free and shares enough characters with it. So a keyword leads if no smaller leader is
near it, and else belongs to the smallest leader that is. What is near depends on the set of
characters alone, so one keyword, the smallest, stands for all with its set.

Rounds: the ``BATCH`` smallest undecided keywords are decided one by one, since every leader
that is smaller than them is known; then all other keywords are held against the round's new
leaders where they lie, by masks of characters, and those near one are decided too. The driver
holds one batch at a time. Each round decides its batch at least; in practice few leaders are
near everything, so rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: Keywords that a round decides one by one, and rows that a task compares with leaders at once.
BATCH, ROWS = 1024, 4096


def _masks(sets: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """A row of 64-bit words per set of characters, over an alphabet; other characters are left out."""
    out = np.zeros((len(sets), max(1, -(-len(alphabet) // 64))), np.uint64)
    for i, letters in enumerate(sets):
        for letter in letters:
            at = alphabet.get(letter)
            if at is not None:
                out[i, at >> 6] |= np.uint64(1 << (at & 63))
    return out


class Leaders:
    """Leaders in sorted order, and who is near them."""

    def __init__(self, names: list[str], sets: list[str], threshold: float):
        self.names, self.threshold = names, threshold
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(sets))))}
        self.masks, self.sizes = _masks(sets, self.alphabet), np.array([len(s) for s in sets])

    def near(self, sets: list[str]) -> np.ndarray:
        """Whether each set is near each leader."""
        masks = _masks(sets, self.alphabet)
        common = np.zeros((len(sets), len(self.names)), np.int64)
        for word in range(masks.shape[1]):
            common += np.bitwise_count(masks[:, word, None] & self.masks[None, :, word])
        sizes = np.array([len(s) for s in sets])
        return (common >= self.threshold * (sizes[:, None] + self.sizes[None, :] - common)) & (sizes[:, None] > 0)

    def first(self, sets: list[str]) -> list[str | None]:
        """The smallest leader near each set."""
        if not self.names or not sets:
            return [None] * len(sets)
        near = self.near(sets)
        return [self.names[i] if some else None for i, some in zip(near.argmax(1), near.any(1))]


def _greedy(names: list[str], sets: list[str], threshold: float) -> list[str | None]:
    """The leader of each keyword of a batch, in sorted order; none for those that lead."""
    near = Leaders(names, sets, threshold).near(sets)
    leads, out = np.zeros(len(names), bool), []
    for i in range(len(names)):
        before = np.flatnonzero(near[i, :i] & leads[:i])
        leads[i] = not len(before)
        out.append(names[before[0]] if len(before) else None)
    return out


def leaders_of(keywords: DataFrame, threshold: float = 0.5, batch: int = BATCH) -> DataFrame:
    """(keyword, leader) of distinct keywords; a leader is its own."""
    spark = keywords.sparkSession
    letters = F.array_join(F.array_sort(F.array_distinct(F.split("keyword", ""))), "")
    known = checkpointed(spark, keywords.select("keyword", letters.alias("letters")).distinct())
    sets = known.groupBy("letters").agg(F.min("keyword").alias("name"))
    free = checkpointed(spark, sets)
    decided = None
    while True:
        rows = free.orderBy("name").limit(batch).collect()  # a batch, whatever the number of keywords
        if not rows:
            break
        names, own = [r.name for r in rows], [r.letters for r in rows]
        found = _greedy(names, own, threshold)
        chosen = [(n, s) for n, s, leader in zip(names, own, found) if leader is None]
        leaders = Leaders([n for n, _ in chosen], [s for _, s in chosen], threshold)
        here = spark.createDataFrame([(s, leader or n) for n, s, leader in zip(names, own, found)], "letters string, leader string")

        def hold(frames: Iterator[pd.DataFrame], leaders: Leaders = leaders) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), ROWS):
                    some = frame.iloc[at : at + ROWS]
                    yield some.assign(leader=pd.array(leaders.first(some["letters"].tolist()), "object"))

        others = free.where(F.col("name") > names[-1]).mapInPandas(hold, "letters string, name string, leader string")
        others = checkpointed(spark, others)
        new = here.unionByName(others.where("leader IS NOT NULL").select("letters", "leader"))
        decided = checkpointed(spark, new if decided is None else decided.unionByName(new))
        free = others.where("leader IS NULL").select("letters", "name")
    if decided is None:
        return known.select("keyword", F.col("keyword").alias("leader"))
    return known.join(decided, "letters").select("keyword", "leader")


def clusters(ranked: DataFrame, threshold: float = 0.5, order: list[str | Column] | None = None, batch: int = BATCH) -> DataFrame:
    """(leader, member, ord) of distinct keywords: each leader with members, then its members in ``order`` (by place).

    Keywords that join no other are left out.
    """
    found = leaders_of(ranked, threshold, batch)
    sizes = found.groupBy("leader").agg(F.count("*").alias("size")).where("size > 1").select("leader")
    members = found.join(sizes, "leader").join(ranked, "keyword")
    own = Window.partitionBy("leader").orderBy(F.col("keyword") != F.col("leader"), *(order or ["place"]), "keyword")
    return members.select("leader", F.col("keyword").alias("member"), (F.row_number().over(own) - 1).cast("int").alias("ord"))
