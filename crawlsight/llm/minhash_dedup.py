"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures.

1. A document's set: its distinct five-word shingles. Its signature: ``COORDINATES``
   minhash values of ``BITS`` bits. Equal sets form one class and are treated once.
2. Multi-index. The signature is split into ``BLOCKS`` blocks of ``WIDTH`` values.
   Two signatures that differ in at most ``BLOCKS * (ERRORS + 1) - 1`` values agree,
   by the pigeonhole principle, in some block up to ``ERRORS`` values. Allowed errors
   are enumerated: a block enters the index once for each way to leave out ``ERRORS``
   of its values, so both sides of such a pair share a key. All pairs under that
   distance are candidates, and most pairs beyond it: at the similarity of 0.85 a
   pair shares no key with a chance of 3e-7.
3. Keys in no other set are dropped by a packed exchange before any key becomes a row.
4. Candidates are confirmed on the full sets, in two rounds. In the first each
   bucket's members are compared with its smallest one, and the confirmed links give
   components. In the second, only members of a bucket that lie in different
   components are compared: a link within a component changes nothing. Sets whose
   own shingles rule out any link are left out of it, and pairs by what they can
   share at most: what both share with their bucket's smallest member, as far as one of
   them shares it, and what they have in common beyond that member. So a group of n
   near copies takes about n comparisons, also where they are linked with nothing but
   their origin's likeness, and no link between components is lost.

Edge cases: null texts, empty texts and texts of white space have an empty set and
link with nothing; texts with fewer than five words have one shingle, the whole
sequence; rows with the same doc_id are one document with several texts and share
their component; rows without doc_id link with nothing and are kept;
the doc_id 2^63-1 stands for a missing one and
comes back as null; very long texts
enter with all their shingles; an empty table gives an empty result; extra columns are
ignored by ``near_groups`` and returned as they are by ``drop_near_copies``, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .components import components
from .packed_sets import BUCKET_KEYS, supports
from .shingles import batches, mixed, text_shingles
from .words import unused
from .workspace import Workspace

BITS, BLOCKS, WIDTH, ERRORS = 16, 10, 6, 1
COORDINATES = BLOCKS * WIDTH
#: Signatures per row of the signature table.
ROWS = 2048
#: Most doc_ids that are broadcast (8 MB); beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240611)
_FACTORS = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minhash signatures of non-empty sets that lie end to end."""
    out = np.empty((len(counts), COORDINATES), np.uint16)
    if not len(counts):
        return out
    short = (values >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for i in range(COORDINATES):
        least = np.minimum.reduceat(short * _FACTORS[i] + _TERMS[i], first)
        out[:, i] = (mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The index keys of each signature: one per block and left-out value."""
    blocks = signature.reshape(-1, BLOCKS, WIDTH).astype(np.uint64)
    salted = mixed(blocks + (np.arange(BLOCKS * WIDTH, dtype=np.uint64).reshape(BLOCKS, WIDTH) << np.uint64(BITS)) + np.uint64(1))
    total = salted.sum(axis=2, keepdims=True, dtype=np.uint64)
    out = np.arange(BLOCKS * WIDTH, dtype=np.uint64).reshape(BLOCKS, WIDTH)
    return mixed((total - salted) ^ (out << np.uint64(48))).reshape(len(signature), COORDINATES)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in batches(texts):
        yield text_shingles(part)


def signed(documents: DataFrame) -> DataFrame:
    """(chunk, body): doc_ids, set sizes, set digests and signatures, packed by the thousand."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        for batch in parts:
            ids = np.array(batch.column("doc_id").fill_null(int(C.NO_ID)).to_pylist(), np.int64)
            for at in range(0, len(ids), ROWS):
                texts = [(t.as_py() or "").encode() for t in batch.column("text")[at : at + ROWS]]
                sizes, digests, found = [], [], []
                for values, counts in _sets(texts):
                    cut = np.cumsum(counts)[:-1]
                    digests += [_digest(v) for v in np.split(values, cut)]
                    sizes.append(counts)
                    found.append(signatures(values, counts[counts > 0]))
                size = np.concatenate(sizes)
                whole = np.zeros((len(size), COORDINATES), np.uint16)
                whole[size > 0] = np.concatenate(found)
                digest = np.frombuffer(b"".join(digests), np.uint8)
                body = C.pack(ids[at : at + ROWS], size.astype(np.int64), digest, whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + made], pa.int64()), pa.array([body], pa.binary())], ["chunk", "body"]
                )
                made += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "chunk long, body binary")


class _Signed:
    def __init__(self, row):
        ids, sizes, digests, signature = C.unpack(row.body, "i8", "i8", "u1", "u2")
        self.number, self.ids, self.sizes = int(row.chunk), ids, sizes
        self.digests, self.signature = digests.reshape(-1, 16), signature.reshape(-1, COORDINATES)

    def distinct(self) -> np.ndarray:
        """One row of each non-empty set."""
        some = np.flatnonzero(self.sizes > 0)
        pairs = np.ascontiguousarray(self.digests[some]).view("<u8").reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(pairs[order, 0]) != 0) | (np.diff(pairs[order, 1]) != 0)
        return np.sort(some[order[new]])


def _each(table: DataFrame, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                for columns in make(_Signed(row), row):
                    yield pd.DataFrame(dict(zip(names, columns)))

    return table.mapInPandas(run, schema)


def _similar(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (doc_id a, doc_id b) of pairs (a, b, doc_a, doc_b) of digests whose sets are similar enough."""
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    similar = pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * union)
    return similar.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def near_groups(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    spark = documents.sparkSession
    space = Workspace(spark, "minhash-dedup")
    table = space.write(signed(documents), "signatures", "none")

    def listed(part: _Signed, row):
        digests = [d.tobytes() for d in part.digests]
        yield pd.Series(part.ids, dtype="Int64").mask(part.ids == C.NO_ID), part.sizes, digests

    members = space.write(_each(table, listed, "doc_id long, n_shingles long, digest binary"), "members")
    classes = space.write(
        members.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("n")),
        "classes",
    )
    buckets = max(1, -(-classes.count() * BLOCKS * WIDTH // BUCKET_KEYS))

    def keyed(part: _Signed) -> tuple[np.ndarray, np.ndarray]:
        rows = part.distinct()
        return rows, index_keys(part.signature[rows]).ravel()

    def ask(part: _Signed, row):
        rows, keys = keyed(part)
        places = np.repeat(rows, BLOCKS * WIDTH)
        asked = list(C.repeat_questions(part.number, keys, places, buckets))
        if asked:
            yield [list(c) for c in zip(*asked)]

    questions = _each(table, ask, "bucket long, chunk long, body binary")
    answers = space.write(C.answered(questions, C.repeat_answers), "answers", "none")

    def shared(part: _Signed, row):
        rows, keys = keyed(part)
        places = np.repeat(rows, BLOCKS * WIDTH)
        unique, bucket, index, _ = C.repeat_keys(keys, places, buckets)
        hit = np.flatnonzero(C.repeat_flags(row.answers, unique, bucket)[index])
        if len(hit):
            digests = {r: part.digests[r].tobytes() for r in np.unique(places[hit]).tolist()}
            yield keys[hit].view(np.int64), [digests[r] for r in places[hit].tolist()]

    postings = _each(C.returned(table, answers, "answers"), shared, "key long, digest binary").distinct()
    postings = space.write(postings.join(classes.select("digest", "first", "n"), "digest"), "postings")
    member = F.struct("first", "digest", "n")
    pivots = postings.groupBy("key").agg(F.min(member).alias("p"), F.max(member).alias("q")).where("p.digest <> q.digest")
    pivots = space.write(pivots.select("key", "p"), "pivots")
    filed = space.write(postings.join(pivots, "key"), "filed")
    space.drop("postings")
    tested = (
        filed.where(F.col("digest") != F.col("p.digest"))
        .where(_similar(F.col("n"), F.col("p.n"), percent))
        .select(F.col("digest").alias("a"), F.col("first").alias("doc_a"), F.col("p.digest").alias("b"), F.col("p.first").alias("doc_b"))
        .distinct()
    )
    tested = space.write(tested, "tested")
    wanted = filed.select("digest", "first").distinct()
    sets = space.write(_full_sets(documents, wanted), "sets")
    copies = _copies(members)
    links = space.write(_confirmed(tested, sets, percent).union(copies), "links")
    labels = components(links, space, "round1")
    placed = filed.join(labels, filed["first"] == labels["node"], "left").select(
        "key", "digest", "first", "n", F.coalesce("component", "first").alias("component")
    )
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = space.write(placed.join(split.select("key"), "key", "left_semi"), "open")
    held = supports(sets.join(open_.select("digest").distinct(), "digest", "left_semi"), space)
    able = held.where(100 * F.col("support") >= percent * F.col("n")).select("digest", "support")
    # A set has at most as many keys as the index gives it.
    able = open_.groupBy("digest", "first", "n", "component").agg(F.collect_set("key").alias("keys")).join(able, "digest")
    able = space.write(able, "able")
    one = able.withColumn("key", F.explode("keys")).join(pivots.select("key", F.col("p.digest").alias("pivot")), "key")
    one = space.write(one.join(_beyond(one, sets), ["digest", "pivot"], "left"), "one")
    other = one.select("key", *[F.col(c).alias(f"{c}_b") for c in (*able.columns, "inner", "beyond")])
    most = F.least("support", "support_b")
    common = F.least("inner", "inner_b") + F.size(F.array_intersect("beyond", "beyond_b"))
    enough = F.isnull("beyond") | F.isnull("beyond_b") | (100 * common >= percent * (F.col("n") + F.col("n_b") - common))
    crossing = (
        one.join(other, "key")
        .where((F.col("digest") < F.col("digest_b")) & (F.col("component") != F.col("component_b")))
        .where(_similar(F.col("n"), F.col("n_b"), percent))
        .where(100 * most >= percent * (F.col("n") + F.col("n_b") - most))
        .where(F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key"))  # a pair comes from one bucket only
        .where(enough)
        .select(F.col("digest").alias("a"), F.col("first").alias("doc_a"), F.col("digest_b").alias("b"), F.col("first_b").alias("doc_b"))
    )
    found = space.write(_confirmed(crossing, sets, percent), "found")
    if not found.isEmpty():
        labels = components(links.union(found), space, "round2")
    return (
        members.join(classes.select("digest", "first"), "digest", "left")
        .withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
        .join(labels, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "node").alias("component_id"),
            F.coalesce(F.coalesce("component", "node") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _beyond(one: DataFrame, sets: DataFrame) -> DataFrame:
    """(digest, pivot, inner, beyond): what a set shares with its bucket's pivot, in number, and what it has beyond it.

    ``beyond`` is null for sets that have more beyond the pivot than in it: for those
    the pivot says little, and the rows stay small.
    """
    left = sets.select("digest", F.col("shingles").alias("own"))
    right = sets.select(F.col("digest").alias("pivot"), F.col("shingles").alias("theirs"))
    found = one.select("digest", "pivot").distinct().join(left, "digest").join(right, "pivot")
    beyond = F.array_except("own", "theirs")
    inner = F.size("own") - F.size(beyond)
    return found.select("digest", "pivot", inner.alias("inner"), F.when(F.size(beyond) <= inner, beyond).alias("beyond"))


def _copies(members: DataFrame) -> DataFrame:
    """Links between the classes that share a doc_id."""
    several = members.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")
    ).where("low <> high").select("doc_id")
    first = members.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return (
        members.where("n_shingles > 0")
        .join(several, "doc_id", "left_semi")
        .join(first, "digest")
        .select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    )


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the wanted classes (digest, first), from the documents themselves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            for values, counts in _sets(texts):
                cut = np.concatenate(([0], np.cumsum(counts)))
                digests = [_digest(values[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), lists], ["digest", "shingles"])

    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(run, "digest binary, shingles array<long>")
    return sets.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def drop_near_copies(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``documents`` that stay: one document of each group."""
    (name,) = unused(documents.columns, "gone")
    groups = near_groups(documents.select("doc_id", "text"), percent)
    gone = Workspace(documents.sparkSession, "minhash-drop").write(
        groups.where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone"
    )
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*[f"`{c}`" for c in documents.columns])
