"""Exact top-k inner-product search by no-random-access aggregation.

Every component of a vector is one list of (row, contribution) per query, read
in falling order of contribution. A block of candidates is sorted once per
component, and its lists are written; a query reads a component's list from its
upper end if its own component is positive and from the lower end if it is negative.
Reading is sequential, all lists to the same depth, in rounds that each go
``GROWTH`` times as deep and read only what is new. After each round

* a row met somewhere scores at least the sum of the lists' final contributions
  plus what its read entries exceed those by;
* an outsider, not met in any list, scores at most the sum of the lists' last
  read contributions.

Reading stops when no outsider can reach the k-th best lower bound. Until then no
row is looked at but through the lists. A row that was met scores at most the sum of
the last read contributions plus what its read entries exceed those by; the rows that
this lets reach the k-th best lower bound get their final score resolved as an exact
integer sum.

Candidates are taken in blocks of ``block_rows`` and queries in blocks of
``query_rows``. A candidate block's lists are dealt once, and the query blocks follow
them in order: a task holds the lists of one block and streams the queries past
them, so the bytes of the lists that move don't depend on the number of queries. A
candidate block returns k rows per query.

Edge cases: components become floor(256 * x) with x as double; vectors that are
null, empty, or hold a component that is null or non-finite, times 256 at least, take
no part; vectors of different length are compared as if padded with zeros; bounds keep
a margin where float64 sums aren't exact, and final scores are integers of any size: a
score beyond a long ranks as what it is and is given as the nearest long; rows of equal
score are ordered by vec_id; a row never meets rows with its own vec_id; rows without
vec_id take no part; repeated rows (same vec_id and vector) count once; of several vectors
with one vec_id each is a query with ranks of its own, and as candidates the best counts;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import pack, unpack
from .workspace import Workspace

#: The first round reads such a part of the lists, each other round so many times as deep as the one before.
FIRST, GROWTH = 64, 1.5
#: Sums of magnitudes up to which float64 holds every integer, and up to which a long does; beyond the last, bounds are of no use.
EXACT, LONG, HUGE = 2.0**53, 2.0**63, 2.0**1000
#: Stands for a query block's number where a row holds a block's lists: they come before the queries.
LISTS = -1
HIT = "query_id long, vector long, vec_id long, score long, place binary"


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: array of the integer components, for the vectors that take part."""
    times = lambda x: x.cast("double") * 256
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(times(x)) < F.lit(float("inf"))))
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  a long would cut the rest
    return (
        embeddings.where("vec_id IS NOT NULL AND size(embedding) > 0")
        .where(usable)
        .select("vec_id", F.transform("embedding", lambda x: floor(times(x))).alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )


class Lists:
    """One sorted list per component over a block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.rows, self.n = ids, rows, len(rows)
        self.row = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.uint32)) if order is None else order
        self.value = np.take_along_axis(np.ascontiguousarray(rows.T), self.row.astype(np.int64), axis=1)
        #: The largest magnitude of each component.
        self.largest = np.maximum(np.abs(self.value[:, 0]), np.abs(self.value[:, -1]))

    def packed(self) -> bytes:
        return pack(np.array(self.rows.shape, np.int64), self.ids, self.rows, self.row)

    @classmethod
    def unpacked(cls, body: bytes) -> Lists:
        shape, ids, rows, order = unpack(body, "i8", "i8", "f8", "u4")
        return cls(ids, rows.reshape(shape), order.reshape(shape[::-1]))

    def frontier(self, query: np.ndarray, depth: int) -> np.ndarray:
        """The last contribution that each list gives when read to a depth."""
        return np.where(query > 0, self.value[:, self.n - depth], self.value[:, depth - 1]) * query

    def read(self, query: np.ndarray, begin: int, end: int, base: np.ndarray) -> np.ndarray:
        """Per row, the sum of what its entries from a depth to another exceed ``base`` by."""
        out = np.zeros(self.n)
        for some, at in ((query > 0, slice(self.n - end, self.n - begin)), (query < 0, slice(begin, end))):
            if some.any():
                gave = self.value[some, at] * query[some, None] - base[some, None]
                out += np.bincount(self.row[some, at].ravel(), gave.ravel(), self.n)
        return out


def contenders(lists: Lists, query: np.ndarray, other: np.ndarray, need: int) -> np.ndarray:
    """The rows that may be among the ``need`` best, by reading the lists until outsiders can't."""
    n = lists.n
    with np.errstate(over="ignore"):
        most = float(lists.largest @ np.abs(query))
    if not most < HUGE:
        return np.flatnonzero(other)
    # What float64 sums of so many rounded products can be off by, with room.
    margin = 0.0 if most <= EXACT else (len(query) + 8) * 2.0**-48 * most
    final = lists.frontier(query, n)
    lower = np.where(other, final.sum(), -np.inf)
    depth, deeper = 0, max(1, n // FIRST)
    while True:
        lower += lists.read(query, depth, deeper, final)
        depth = deeper
        kth = np.partition(lower, n - need)[n - need]
        ends = lists.frontier(query, depth)
        if ends.sum() + margin < kth - margin or depth == n:
            break
        deeper = min(n, max(depth + 1, int(depth * GROWTH)))
    upper = ends.sum() + lists.read(query, 0, depth, ends)
    return np.flatnonzero(other & (upper + margin >= kth - margin))


def nra_block(lists: Lists, query_ids: list[tuple[int, int]], queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The k best (query_id, its vector's number, vec_id, score, place in the order of scores) of one block of rows for each query."""
    width = max(lists.rows.shape[1], queries.shape[1])
    if lists.rows.shape[1] < width:
        lists = Lists(lists.ids, _wide(lists.rows, width))
    whole = _integers(lists.rows)
    for (query_id, vector), query in zip(query_ids, _wide(queries, width)):
        other = lists.ids != query_id
        need = min(k, int(other.sum()))
        if not need:
            continue
        left = contenders(lists, query, other, need)
        with np.errstate(over="ignore"):
            most = float(lists.largest @ np.abs(query))
        if most <= EXACT:
            score = lists.rows[left] @ query if 2 * len(left) < lists.n else (lists.rows @ query)[left]
            order = np.lexsort((lists.ids[left], -score))
        elif whole.dtype != object and most < LONG / 2:
            score = whole[left] @ query.astype(np.int64)
            order = np.lexsort((lists.ids[left], -score))
        else:
            wanted = [int(x) for x in query]
            score = [sum(map(operator.mul, map(int, whole[i]), wanted)) for i in left]
            order = sorted(range(len(left)), key=lambda j: (-score[j], lists.ids[left[j]]))
        for j in order[:k]:
            exact = int(score[j])
            yield int(query_id), int(vector), int(lists.ids[left[j]]), max(-(2**63), min(2**63 - 1, exact)), ordered(exact)


def ordered(number: int) -> bytes:
    """Bytes that sort as integers do, of any size: sign and length, then the magnitude."""
    size = (abs(number).bit_length() + 7) // 8
    if number >= 0:
        return (32768 + size).to_bytes(2, "big") + number.to_bytes(size, "big")
    return (32768 - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + number).to_bytes(size, "big")


def top_k(
    embeddings: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 2048
) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries`` (vec_id, embedding)."""
    space = Workspace(embeddings.sparkSession, "top-k")
    base, asked = scaled(embeddings), scaled(queries)
    blocks = max(1, -(-embeddings.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // query_rows))
    deal = lambda name, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        body = Lists(group["vec_id"].to_numpy(np.int64), _matrix(group["v"])).packed()
        return pd.DataFrame({"block": group["block"].iloc[:1], "lists": [body]})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(group["v"])
        body = pack(np.array(rows.shape, np.int64), group["vec_id"].to_numpy(np.int64), group["vector"].to_numpy(np.int64), rows)
        return pd.DataFrame({"query_block": group["query_block"].iloc[:1], "asks": [body]})

    lists = base.select("vec_id", "v", deal("block", blocks)).groupBy("block").applyInPandas(build, "block long, lists binary")
    lists = space.write(lists, "lists", "none")
    numbered = asked.withColumn("vector", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long"))
    asks = numbered.select("vec_id", "vector", "v", deal("query_block", query_blocks)).groupBy("query_block")
    asks = space.write(asks.applyInPandas(gather, "query_block long, asks binary"), "asks", "none")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for frame in frames:
            for block, query_block, body in zip(frame["block"], frame["query_block"], frame["body"]):
                if query_block == LISTS:
                    at, held = block, Lists.unpacked(body)
                elif block == at:  # else a block that no candidate fell into
                    shape, ids, vectors, rows = unpack(body, "i8", "i8", "i8", "f8")
                    hits = list(nra_block(held, list(zip(ids, vectors)), rows.reshape(shape), k))
                    out = pd.DataFrame(hits, columns=["query_id", "vector", "vec_id", "score", "place"])
                    yield out.astype({"query_id": "int64", "vector": "int64", "vec_id": "int64", "score": "int64"})

    number = F.lit(LISTS).cast("long").alias("query_block")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    dealt = lists.select("block", number, F.col("lists").alias("body")).union(asks.select(each, "query_block", F.col("asks").alias("body")))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "query_block")
    hits = dealt.mapInPandas(search, HIT)
    order = Window.partitionBy("query_id", "vector").orderBy(F.col("best.place").desc(), "vec_id")
    return (
        hits.groupBy("query_id", "vector", "vec_id")
        .agg(F.max(F.struct("place", "score")).alias("best"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.col("best.score").alias("score"))
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors))))
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return out


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _integers(rows: np.ndarray) -> np.ndarray:
    if (np.abs(rows) < LONG).all():
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], object)
