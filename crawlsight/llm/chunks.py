"""Texts in chunks, and a hash-partitioned exchange of packed keys between chunks.

Operators that must look at every position of every text can't afford a Spark row
per position. They work on chunks: rows that hold a few megabytes of compressed
text each, written once to the shared folder, so that a chunk keeps its number and
content whatever executor reads it. What a chunk has to ask of the others is packed
into one binary value per bucket and dealt to the bucket's owner; the owner's
answer, one value per question, returns to the chunk by a join.

Keys are unique within a question, so a key that a third of all texts share
reaches its owner once per chunk, never once per text. A bucket holds the distinct keys of
``BUCKET_BYTES`` of text on average; what an owner holds beyond them grows with the number
of chunks that share a bucket's keys, a packed key and an entry per chunk. In
``exchanged``, an owner has a range of buckets and takes one at a time; a task's
questions to a range travel as one row per ``BATCH_BYTES``, and ranges are as many
as the session has shuffle partitions while they stay below ``RANGE_BYTES`` of text:
rows grow with tasks and partitions, not with chunks and buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Bytes of text per chunk, unless a single text is longer.
CHUNK_BYTES = 2 << 20
#: Texts per chunk at most.
CHUNK_TEXTS = 1 << 16
#: Bytes of text per bucket: the memory of an owner doesn't grow with the input.
BUCKET_BYTES = 8 << 20
#: Bytes of text per range of buckets at most: their questions are held packed, in about as many bytes.
RANGE_BYTES = 64 << 20
#: Bytes of packed questions that a task holds back to send them together.
BATCH_BYTES = 24 << 20
#: Bytes of answers that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Stands for a missing doc_id; such rows sort after all others.
NO_ID = np.iinfo(np.int64).max
#: Number of the question that is a note of the chunk to itself.
NOTE = -1
CHUNK = "chunk long, ids binary, sizes binary, body binary, bucket long, question binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    raw = sizes.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of them small, byte plane by byte plane."""
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising unsigned keys as differences, byte plane by byte plane: dense keys need few bytes each."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:width]).tobytes())


def unpack_sorted(body: bytes) -> np.ndarray:
    width = body[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """The texts of a chunk: ``data`` holds them end to end; ``starts`` has one more entry than texts."""

    def __init__(self, row):
        self.number = int(row.chunk)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(row.sizes, np.int64))))
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.body), np.uint8)

    @classmethod
    def of(cls, number: int, ids: np.ndarray, sizes: np.ndarray, text) -> Chunk:
        """A chunk that is just being made."""
        out = cls.__new__(cls)
        out.number, out.ids = number, ids
        out.starts = np.concatenate(([0], np.cumsum(sizes)))
        out.data = np.frombuffer(text, np.uint8)
        return out

    def owners(self) -> np.ndarray:
        """The index of the text that each byte belongs to."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))


def chunked(documents: DataFrame, space: Workspace, ask: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc_id, text) as chunks, and the first questions of each; null texts are empty.

    ``ask(chunk)`` yields (bucket, chunk's number, question). A question to the
    bucket ``NOTE`` stays with the chunk, as its column ``note``. Both come from one
    pass over the texts and one written table, which suits questions that are small
    beside the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            at = 0
            while at < len(ids):
                until = int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1
                until = min(max(at + 1, until), at + CHUNK_TEXTS, len(ids))
                text = data[ends[at] : ends[until]]
                chunk = Chunk.of((part << 32) + made, ids[at:until], np.diff(ends[at : until + 1]), text)
                asked = list(ask(chunk)) if ask else []
                note = next((q for b, _, q in asked if b == NOTE), None)
                body = zstandard.ZstdCompressor(level=2).compress(text)
                sizes = np.diff(chunk.starts).tobytes()
                rows = [(chunk.number, chunk.ids.tobytes(), sizes, body, None, note)]
                rows += [(chunk.number, None, None, None, b, q) for b, _, q in asked if b != NOTE]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["chunk", "ids", "sizes", "body", "bucket", "question"],
                )
                made += 1
                at = until

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = plain.mapInArrow(run, CHUNK).withColumn("asked", F.col("bucket").isNotNull())
    both = space.write_split(both, "chunks", "asked")
    own = both.where("NOT asked").select("chunk", "ids", "sizes", "body", F.col("question").alias("note"))
    return own, both.where("asked").select("bucket", "chunk", F.col("question").alias("body"))


def drop_questions(space: Workspace) -> None:
    """Remove the first questions of ``chunked``, once they are answered."""
    space.drop("chunks/asked=true")


def bucket_count(documents: DataFrame) -> int:
    """Buckets for the keys of all texts, by their total size."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key: buckets are ranges of the key's leading bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def asked(chunks: DataFrame, ask: Callable, schema: str = "bucket long, chunk long, body binary") -> DataFrame:
    """Rows that ``ask(chunk, row)`` yields for each chunk."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                rows = list(ask(Chunk(row), row))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return chunks.mapInPandas(run, schema)


def answered(questions: DataFrame, answer: Callable) -> DataFrame:
    """(chunk, bucket, body): the owners' answers.

    ``answer(bodies)`` gets all questions of a bucket and returns a value for each.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"chunk": group["chunk"], "bucket": group["bucket"], "body": answer(group["body"].tolist())}
        )

    return questions.groupBy("bucket").applyInPandas(run, "chunk long, bucket long, body binary")


def returned(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``chunks`` with the array ``name`` of (bucket, body), in order of bucket; null without answers.

    The chunks stay where they are if all answers together have at most
    ``BROADCAST_BYTES``, and are shuffled otherwise.
    """
    total = answers.agg(F.sum(F.length("body") + 32)).first()[0] or 0
    parts = F.array_sort(F.collect_list(F.struct("bucket", "body"))).alias(name)
    gathered = answers.groupBy("chunk").agg(parts)
    return chunks.join(F.broadcast(gathered) if total <= BROADCAST_BYTES else gathered, "chunk", "left")


def framed(names: list[tuple[int, int]], bodies: list[bytes]) -> bytes:
    """Values with the bucket and the chunk of each, as one value."""
    heads = np.array([(b, c, len(body)) for (b, c), body in zip(names, bodies)], np.int64)
    return len(bodies).to_bytes(8, "little") + heads.tobytes() + b"".join(bodies)


def unframed(body: bytes) -> Iterator[tuple[int, int, bytes]]:
    n = int.from_bytes(body[:8], "little")
    at = 8 + 24 * n
    for bucket, chunk, size in np.frombuffer(body, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        yield bucket, chunk, body[at : at + size]
        at += size


def exchanged(
    chunks: DataFrame, ask: Callable, answer: Callable, buckets: int, space: Workspace, name: str, note: str | None = None
) -> tuple[DataFrame, int]:
    """``chunks`` with the array ``name`` of (bucket, body), in order of bucket, and the sum of the owners' numbers.

    ``ask(chunk, row)`` yields (bucket, question), ``answer(questions)`` gets all
    questions of a bucket and returns an answer for each and a number. Questions are
    framed by batch: some chunks of one task, known by the number of the first.
    Answers meet their chunks in a shuffle join at every size. A question to the
    bucket ``NOTE`` stays with the chunk, as the column ``note``, if that is named.
    """
    ranges = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, min(-(-buckets // ranges), RANGE_BYTES // BUCKET_BYTES))

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        batch, size = None, 0

        def batched() -> pd.DataFrame:
            rows = [(r, batch, framed(*held.pop(r))) for r in list(held)]
            return pd.DataFrame(rows, columns=["range", "batch", "body"])

        for frame in frames:
            for row in frame.itertuples(index=False):
                chunk = Chunk(row)
                for bucket, body in ask(chunk, row):
                    if bucket == NOTE:
                        yield pd.DataFrame([(NOTE, chunk.number, body)], columns=["range", "batch", "body"])
                        continue
                    names, bodies = held.setdefault(bucket // width, ([], []))
                    names.append((bucket, chunk.number))
                    bodies.append(body)
                    batch = chunk.number if batch is None else batch
                    size += len(body)
                if size > BATCH_BYTES:
                    yield batched()
                    batch, size = None, 0
        if held:
            yield batched()

    def own(group: pd.DataFrame) -> pd.DataFrame:
        questions: dict[int, list] = {}
        for i, body in enumerate(group["body"]):
            for bucket, chunk, question in unframed(body):
                questions.setdefault(bucket, []).append((i, chunk, question))
        out, total = [([], []) for _ in range(len(group))], 0
        for bucket in sorted(questions):
            asked_by = questions.pop(bucket)
            answers, note = answer([q for _, _, q in asked_by])
            total += note
            for (i, chunk, _), body in zip(asked_by, answers, strict=True):
                out[i][0].append((bucket, chunk))
                out[i][1].append(body)
        notes = [total, *[None] * (len(out) - 1)]
        bodies = [framed(*parts) for parts in out]
        return pd.DataFrame({"batch": group["batch"], "body": bodies, "note": pd.array(notes, "Int64")})

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        back: dict[int, list] = {}
        for body in group["body"]:
            for bucket, chunk, part in unframed(body):
                back.setdefault(chunk, []).append((bucket, part))
        parts = [[{"bucket": b, "body": part} for b, part in sorted(some)] for some in back.values()]
        return pd.DataFrame({"chunk": list(back), name: parts})

    questions, notes = chunks.mapInPandas(gather, "range long, batch long, body binary"), None
    if note:
        both = space.write_split(questions.withColumn("own", F.col("range") == NOTE), f"{name}-asked", "own")
        notes = both.where("own").select(F.col("batch").alias("chunk"), F.col("body").alias(note))
        questions = both.where("NOT own")
    answers = questions.groupBy("range").applyInPandas(own, "batch long, body binary, note long")
    answers = space.write(answers, f"{name}-answers", "none")
    if note:
        space.drop(f"{name}-asked/own=false")
    total = answers.agg(F.sum("note")).first()[0] or 0
    parts = answers.groupBy("batch").applyInPandas(dealt, f"chunk long, {name} array<struct<bucket:long,body:binary>>")
    parts = space.write(parts, name, "none")
    space.drop(f"{name}-answers")
    ready = chunks.join(parts.hint("merge"), "chunk", "left")
    return (ready if notes is None else ready.join(notes.hint("merge"), "chunk", "left")), total


def by_bucket(unique: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of keys sorted by bucket."""
    if not len(unique):
        return
    cut = np.flatnonzero(np.diff(buckets)) + 1
    for at, until in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(unique)]))):
        yield int(buckets[at]), slice(int(at), int(until))


# --- which keys occur in more than one place ---------------------------------------------

#: Bits of a key beside its bucket. With a bucket of a few million keys about one key in a
#: thousand meets a stranger; answers are a screen, so that costs work and no result.
KEY_BITS = 30


def repeat_questions(chunk: int, keys: np.ndarray, places: np.ndarray, buckets: int, bits: int = KEY_BITS):
    """One question per bucket: is a key in more than one place?"""
    unique, bucket, _, _, many = ranked_keys(keys, places, buckets, bits)
    return key_questions(chunk, unique, bucket, many)


def key_questions(chunk: int, unique: np.ndarray, bucket: np.ndarray, many: np.ndarray):
    """As ``repeat_questions``, for keys that are ranked already."""
    for b, at in by_bucket(unique, bucket):
        keys = pack_sorted(unique[at] & np.uint64(0xFFFFFFFF))
        yield b, chunk, len(keys).to_bytes(8, "little") + keys + zstandard.ZstdCompressor(level=1).compress(np.packbits(many[at]).tobytes())


def ranked_keys(keys: np.ndarray, places: np.ndarray, buckets: int, bits: int = KEY_BITS):
    """Unique keys cut to (bucket, some bits), their buckets, the order of all keys, how many each is, and whether a chunk has it in two places."""
    short = (bucket_of(keys, buckets).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64((1 << bits) - 1))
    order = np.argsort(short)
    placed, ranked = places[order], short[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    differs = np.zeros(len(first), bool)
    # Equal keys with more than one place have neighbours with different places.
    other = np.flatnonzero(~new[1:] & (placed[1:] != placed[:-1])) + 1
    differs[np.searchsorted(first, other, "right") - 1] = True
    unique = ranked[first]
    return unique, (unique >> np.uint64(32)).astype(np.int64), order, np.diff(first, append=len(order)), differs


def repeat_keys(keys: np.ndarray, places: np.ndarray, buckets: int, bits: int = KEY_BITS):
    """Unique keys cut to (bucket, some bits), their buckets, each key's index, and whether a chunk has it in two places."""
    unique, bucket, order, held_by, differs = ranked_keys(keys, places, buckets, bits)
    index = np.empty(len(order), np.int64)
    index[order] = np.repeat(np.arange(len(unique)), held_by)
    return unique, bucket, index, differs


def repeat_answers(bodies: list[bytes]) -> list[bytes]:
    """A bit per key: it is in another chunk, or in another place of its own."""
    parts = []
    for body in bodies:
        cut = 8 + int.from_bytes(body[:8], "little")
        keys = unpack_sorted(body[8:cut]).astype(np.uint32)
        many = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[cut:]), np.uint8)
        parts.append((keys, np.unpackbits(many, count=len(keys)).astype(bool)))
    everything = np.sort(np.concatenate([k for k, _ in parts]))
    shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for keys, many in parts:
        at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
        found = shared[at] == keys if len(shared) else np.zeros(len(keys), bool)
        out.append(np.packbits(found | many).tobytes())
    return out


def repeat_flags(row_answers, unique: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The answers' bits in the order of ``unique``."""
    bits = {int(a["bucket"]): a["body"] for a in (row_answers if row_answers is not None else [])}
    out = np.zeros(len(unique), bool)
    for b, at in by_bucket(unique, bucket):
        out[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=at.stop - at.start).astype(bool)
    return out
