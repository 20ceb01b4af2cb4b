"""Sets of 64-bit tokens, packed by the hundred, and what they share with each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .workspace import Workspace

#: Sets per row of the packed table.
SETS = 512
#: Keys per bucket of the packed exchange.
BUCKET_KEYS = 1 << 20


class SetRow:
    """Sets that were packed into one row."""

    def __init__(self, row):
        names, self.counts, self.values = C.unpack(row.body, "u1", "i8", "u8")
        self.number, self.names = int(row.chunk), names.reshape(-1, 16)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)

    def name_list(self) -> list[bytes]:
        return [n.tobytes() for n in self.names]


def pack_sets(sets: DataFrame, space: Workspace, name: str) -> DataFrame:
    """A written table of packed sets (name, tokens); a name has 16 bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        for batch in parts:
            for at in range(0, batch.num_rows, SETS):
                some = batch.slice(at, SETS)
                lists = some.column(1)
                counts = np.diff(lists.offsets.to_numpy())
                names = np.frombuffer(b"".join(some.column(0).to_pylist()), np.uint8)
                body = C.pack(names, counts.astype(np.int64), lists.flatten().to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + made], pa.int64()), pa.array([body], pa.binary())], ["chunk", "body"]
                )
                made += 1

    return space.write(sets.mapInArrow(run, "chunk long, body binary"), name, "none")


def each_row(table: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows of the columns that ``make(sets, row)`` yields for each packed row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                for columns in make(SetRow(row), row):
                    yield pd.DataFrame(dict(zip(names, columns)))

    return table.mapInPandas(run, schema)


def shared_keys(table: DataFrame, keys: Callable, buckets: int, space: Workspace, name: str) -> DataFrame:
    """``table`` with the answers, per key that ``keys(sets)`` gives with its owner, whether another set has it."""

    def ask(part: SetRow, row):
        asked = list(C.repeat_questions(part.number, *keys(part), buckets))
        if asked:
            yield [list(c) for c in zip(*asked)]

    questions = each_row(table, ask, "bucket long, chunk long, body binary")
    return C.returned(table, space.write(C.answered(questions, C.repeat_answers), name, "none"), "answers")


def key_flags(row, values: np.ndarray, owner: np.ndarray, buckets: int) -> np.ndarray:
    """Whether another set has each of these keys, by the answers of ``shared_keys``."""
    unique, bucket, index, _ = C.repeat_keys(values, owner, buckets)
    return C.repeat_flags(row.answers, unique, bucket)[index]


def supports(sets: DataFrame, space: Workspace) -> DataFrame:
    """(digest, n, support): how many tokens of a set (digest, shingles) occur in another of these sets.

    Two sets can't share more than the smaller support, which bounds their
    similarity: a copy with many edits of its own is linked with nothing, whatever
    its similarity to a common origin.
    """
    table = pack_sets(sets.select("digest", "shingles"), space, "open-sets")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))

    def support(part: SetRow, row):
        shared = key_flags(row, part.values, part.owner, buckets)
        held = np.bincount(part.owner, shared, minlength=len(part.counts)).astype(np.int64)
        yield part.name_list(), part.counts, held

    ready = shared_keys(table, lambda part: (part.values, part.owner), buckets, space, "open-answers")
    return each_row(ready, support, "digest binary, n long, support long")
