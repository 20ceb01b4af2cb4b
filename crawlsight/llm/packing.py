"""Mixture-controlled packing of token sequences by deficit round-robin.

1. Tokenise. Each task writes, per few megabytes of text and per source, one row
   with the token ids of its documents end to end. A document's ids end with the
   terminator id, so every document has at least one.
2. Queues. A source's rows in order form its queue. A queue's tokens are due in
   proportion to its weight (by default its share of all tokens, so that all
   queues run dry together): the exact amount due at a point of the schedule is a
   real number, its whole part is what has been sent. The schedule is cut into
   partitions of about ``group_tokens``; a queue's sent whole part and its carried
   fraction (its deficit) at each cut have a closed form, so that partitions are
   packed independently and still carry deficits from one to the next.
3. Windows. Within a partition, each window of ``window_sequences`` sequences adds
   each queue's share to its deficit, sends the whole part of it, gives what is
   left of the window to the largest deficits, and carries the rest.
4. Sequences of ``length`` tokens are cut from the stream of windows, through
   documents where need be. What is left at a partition's end becomes sequences
   of powers of two, so nothing is padded.

The number of sources is the one thing held by the driver, one row each. Ids are those
of the vocabulary's tokenizer; they come from its ranks, in 16 bits where they fit and
in 32 where they don't.

Edge cases: null and empty texts consist of the terminator; a very long text is one
row of its source's queue and is cut into sequences like others; a null source is a
source of its own; repeated rows and rows without doc_id are packed as documents of
their own; the doc_id 2^63-1 stands for a missing one and
comes back as null; an empty table gives an empty result; a weight of 0 or less is refused;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, NO_ID, pack, unpack
from .workspace import Workspace

TOKENS = "chunk long, source string, tokens long, body binary"
SLICE = "part long, queue long, at long, body binary"
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)
#: Bytes of queue places that are broadcast at most; beyond it the rows are shuffled.
BROADCAST_BYTES = 16 << 20
#: Sequences of one partition are numbered below this.
PER_PART = 1 << 24
END = "<|endoftext|>"
#: The pattern's white space, which is not Python's. Its matcher fails on runs near a million characters,
#: so that runs from LONG_RUN on are cut out before it.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 1 << 18


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE from its file of ranks; its one special token follows the ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)}
    )


def token_ids(text: str, path: str) -> list[int]:
    """Ids as the tokenizer of the same vocabulary gives them; the special token's string is that token."""
    own = encoder(path)
    if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text)):
        return _long_ids(text, own)
    return own.encode(text, allowed_special="all") if END in text else own.encode_ordinary(text)


def _long_ids(text: str, own: tiktoken.Encoding) -> list[int]:
    """``token_ids`` of a text with very long runs of white space.

    No piece of the pattern goes on from other characters into white space, so one
    begins with the run. It is the whole run at the end of what the special token
    divides, else the run without its last character, which the next piece may
    begin with. That piece is merged without being searched for.
    """
    out: list[int] = []
    for i, part in enumerate(text.split(END)):
        out += [own.eot_token] * (i > 0)
        at = 0
        for run in BLANKS.finditer(part):
            if run.end() - run.start() >= LONG_RUN:
                stop = run.end() - (run.end() < len(part))
                out += own.encode_ordinary(part[at : run.start()])
                out += own._encode_single_piece(part[run.start() : stop])
                at = stop
        out += own.encode_ordinary(part[at:])
    return out


def id_kind(path: str, end_id: int) -> str:
    """The numbers that hold every id of a vocabulary."""
    return "u2" if max(encoder(path).n_vocab, end_id + 1) <= 1 << 16 else "u4"


def tokenised(documents: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """Rows of (chunk, source, tokens, body): the ids of a source's documents in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, part = 0, 0, TaskContext.get().partitionId()
        queues: dict[str | None, list] = {}

        def flush() -> pa.RecordBatch:
            rows = []
            for source, (ids, ends, tokens) in queues.items():
                sizes = np.diff(np.array([0, *ends], np.int64))
                body = pack(np.array(ids, np.int64), sizes, np.array(tokens, np.dtype(kind)))
                rows.append(((part << 32) + made, source, len(tokens), body))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "source", "tokens", "body"])

        for batch in batches:
            numbers = batch.column("doc_id").fill_null(int(NO_ID)).to_pylist()
            sources = batch.column("source").to_pylist()
            for number, source, text in zip(numbers, sources, batch.column("text")):
                text = text.as_py() or ""
                if queues and held + len(text) > CHUNK_BYTES:
                    yield flush()
                    queues, held, made = {}, 0, made + 1
                ids, ends, tokens = queues.setdefault(source, ([], [], []))
                tokens.extend(token_ids(text, path))
                tokens.append(end_id)
                ids.append(number)
                ends.append(len(tokens))
                held += len(text)
        if queues:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, TOKENS)


class Schedule:
    """How much of each queue is due at each cut between partitions."""

    def __init__(self, totals: list[int], weights: list[float] | None, group_tokens: int):
        self.totals, self.weights = totals, weights
        self.parts = max(1, -(-sum(totals) // group_tokens))
        if weights is not None:
            dry = np.array(totals) / np.array(weights)
            self.times = np.concatenate(([0.0], np.sort(dry)))
            self.sent = np.array([np.minimum(totals, np.array(weights) * t).sum() for t in self.times])

    def due(self, queue: int, cut: int) -> float:
        """Tokens due, exactly, at a cut."""
        total = self.totals[queue]
        if cut >= self.parts:
            return total
        if self.weights is None:
            return total * cut // self.parts + total * cut % self.parts / self.parts
        time = np.interp(self.sent[-1] * cut / self.parts, self.sent, self.times)
        return min(total, self.weights[queue] * time)

    def taken(self, queue: int, cut: int) -> int:
        total = self.totals[queue]
        if self.weights is None:
            return total * min(cut, self.parts) // self.parts
        return int(self.due(queue, cut))

    def part_of(self, queue: int, at: int) -> int:
        """The partition that a queue's token falls into."""
        low, high = 0, self.parts - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.taken(queue, middle) <= at else (low, middle - 1)
        return low


def round_robin(shares: np.ndarray, deficits: np.ndarray, held: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(queue, tokens) in sending order: each window sends the queues' shares, deficits are carried."""
    out: list[tuple[int, int]] = []
    left, deficit, turn = held.copy(), deficits.astype(float).copy(), 0
    shares = shares / max(shares.sum(), 1e-300)
    while (rest := int(left.sum())) > 0:
        size = min(window, rest)
        deficit += size * shares
        take = np.clip(np.floor(deficit + 1e-9).astype(np.int64), 0, left)
        if (over := int(take.sum()) - size) > 0:  # carried fractions add up to more than the window
            for queue in np.argsort(deficit - take, kind="stable"):
                cut = min(over, int(take[queue]))
                take[queue] -= cut
                over -= cut
        while (open_ := size - int(take.sum())) > 0:
            wanting = np.flatnonzero(take < left)
            wanting = wanting[np.argsort(take[wanting] - deficit[wanting], kind="stable")]
            each = max(1, open_ // len(wanting))
            for queue in wanting:
                more = min(each, int(left[queue] - take[queue]), open_)
                take[queue] += more
                open_ -= more
        deficit -= take
        left -= take
        order = np.roll(np.arange(len(take)), -turn)
        out += [(int(q), int(take[q])) for q in order if take[q]]
        turn += 1
    return out


def sequence_cuts(total: int, length: int) -> np.ndarray:
    """Ends of sequences: full ones, then powers of two."""
    ends = list(range(length, total + 1, length))
    at, bit = total // length * length, length
    while at < total:
        while bit > total - at:
            bit //= 2
        at += bit
        ends.append(at)
    return np.array(ends, np.int64)


def _packed(part: int, rows: list, schedule: Schedule, names: list, length: int, window: int, with_ids: bool, kind: str) -> pd.DataFrame:
    queues = sorted({int(r[0]) for r in rows})
    ids, first, held, sizes, tokens, base = {}, {}, {}, {}, {}, {}
    for queue in queues:
        own = [unpack(body, "i8", "i8", "i8", "i8", kind) for q, at, body in sorted(rows, key=lambda r: (r[0], r[1])) if q == queue]
        ids[queue], first[queue], sizes[queue], held[queue] = (np.concatenate([o[i] for o in own]) for i in range(4))
        tokens[queue] = np.concatenate([o[4] for o in own])
        base[queue] = np.concatenate(([0], np.cumsum(held[queue])))
    shares = np.array([schedule.due(q, part + 1) - schedule.due(q, part) for q in queues])
    carried = np.array([schedule.due(q, part) - schedule.taken(q, part) for q in queues])
    sent = round_robin(shares, carried, np.array([len(tokens[q]) for q in queues]), window)
    stream, marks, at = [], [], 0
    done = dict.fromkeys(queues, 0)
    for index, count in sent:
        queue, begin = queues[index], done[queues[index]]
        stream.append(tokens[queue][begin : begin + count])
        edges = base[queue]
        inner = edges[np.searchsorted(edges, begin, "right") : np.searchsorted(edges, begin + count, "left")]
        marks.append((queue, begin, at, inner - begin + at))
        done[queue] = begin + count
        at += count
    flat = np.concatenate(stream).astype("<u4")
    ends = sequence_cuts(at, length)
    cuts = np.unique(np.concatenate([[m[2]] for m in marks] + [m[3] for m in marks] + [ends]))
    begins = np.concatenate(([0], cuts[(cuts > 0) & (cuts < at)]))
    stops = np.concatenate((begins[1:], [at]))
    segment = np.searchsorted([m[2] for m in marks], begins, "right") - 1
    sequence = np.searchsorted(ends, begins, "right")
    opened = np.concatenate(([0], ends))[sequence]
    out = []
    for b, e, s, number, o in zip(begins.tolist(), stops.tolist(), segment.tolist(), sequence.tolist(), opened.tolist()):
        queue, begin, at, _ = marks[s]
        place = begin + b - at
        doc = int(np.searchsorted(base[queue], place, "right")) - 1
        body = flat[b:e].tobytes()
        row = (
            int(ids[queue][doc]),
            int(first[queue][doc] + place - base[queue][doc]),
            e - b,
            zlib.crc32(body),
            int(sizes[queue][doc]),
            part * PER_PART + number,
            b - o,
            names[queue],
        )
        out.append((*row, body) if with_ids else row)
    columns = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
    frame = pd.DataFrame(out, columns=columns)
    return frame.assign(doc_id=frame["doc_id"].astype("Int64").mask(frame["doc_id"] == NO_ID))


def _places(rows: DataFrame) -> DataFrame:
    """(chunk, source, at): the tokens of a source's queue before each of its rows.

    Rows are added up within the task that made them, and tasks, one row each, within
    a source: a source with a third of all rows is no hot window.
    """
    task = F.shiftright("chunk", 32)
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select(
        "chunk", "source", task.alias("task"), F.coalesce(F.sum("tokens").over(before("source", task).orderBy("chunk")), F.lit(0)).alias("inner")
    )
    tasks = rows.groupBy("source", task.alias("of_task")).agg(F.sum("tokens").alias("held"))
    tasks = tasks.select(
        F.col("source").alias("of"), "of_task", F.coalesce(F.sum("held").over(before("source").orderBy("of_task")), F.lit(0)).alias("outer")
    )
    found = inner.join(tasks, (F.col("task") == F.col("of_task")) & F.col("source").eqNullSafe(F.col("of")))
    return found.select("chunk", "source", (F.col("inner") + F.col("outer")).alias("at"))


def pack_sequences(
    documents: DataFrame,
    length: int = 1024,
    end_id: int = 0,
    ranks_path: str | None = None,
    weights: dict[str | None, float] | None = None,
    window_sequences: int = 64,
    group_tokens: int = 1 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit numbers.

    ``weights`` maps sources to weights (1 if missing); by default each source
    weighs what it holds.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    space = Workspace(documents.sparkSession, "packing")
    kind = id_kind(path, end_id)
    rows = space.write(tokenised(documents, path, end_id, kind), "tokens", "none")
    held = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    names = sorted(held, key=lambda s: (s is None, s or ""))
    if weights is not None and min(weights.values(), default=1) <= 0:
        raise ValueError("weights must be positive")
    schedule = Schedule(
        [held[s] for s in names], None if weights is None else [float(weights.get(s, 1)) for s in names], group_tokens
    )
    number = {s: i for i, s in enumerate(names)}
    place = space.write(_places(rows), "places")
    same = (rows["chunk"] == place["chunk"]) & rows["source"].eqNullSafe(place["source"])
    taken = place.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    if taken <= BROADCAST_BYTES:
        place = F.broadcast(place)
    queued = rows.join(place, same).select(rows["source"], place["at"], rows["body"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, at, body in zip(frame["source"], frame["at"], frame["body"]):
                queue = number[None if pd.isna(source) else source]
                ids, sizes, tokens = unpack(body, "i8", "i8", kind)
                base = np.concatenate(([0], np.cumsum(sizes)))
                begin, out = 0, []
                while begin < len(tokens):
                    part = schedule.part_of(queue, int(at) + begin)
                    stop = min(len(tokens), schedule.taken(queue, part + 1) - int(at))
                    low = int(np.searchsorted(base, begin, "right")) - 1
                    high = int(np.searchsorted(base, stop, "left"))
                    edges = np.clip(base[low : high + 1], begin, stop)
                    body = pack(ids[low:high], edges[:-1] - base[low:high], sizes[low:high], np.diff(edges), tokens[begin:stop])
                    out.append((part, queue, int(at) + begin, body))
                    begin = stop
                yield pd.DataFrame(out, columns=["part", "queue", "at", "body"])

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        slices = list(zip(group["queue"], group["at"], group["body"]))
        return _packed(int(group["part"].iloc[0]), slices, schedule, names, length, length * window_sequences, with_ids, kind)

    schema = PIECE + ", ids binary" * with_ids
    return queued.mapInPandas(split, SLICE).groupBy("part").applyInPandas(packed, schema)
