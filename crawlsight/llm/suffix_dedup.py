"""Removal of repeated passages: blockwise suffix sorting with a difference cover.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a
document with a smaller doc_id. Only suffixes' first ``WIDTH`` bytes matter, so a
full suffix array is never held; suffixes are sorted one bucket at a time, and only
those that may be tied with a suffix of another document.

1. Cover sample. The positions whose residue modulo ``PERIOD`` lies in the
   difference cover ``COVER`` form the sample: for any two positions some shift
   below ``PERIOD`` puts both into it. Two equal strings of ``WIDTH`` bytes thus
   have, at one such shift, sampled suffixes that agree on their next ``SAMPLE``
   bytes. An exchange by hash tells which sampled suffixes are tied with one of
   another document.
2. Suffixes without a tied sample in their first ``PERIOD`` positions can't repeat
   and go no further. The hashes of the others' ``WIDTH`` bytes are screened in the
   same way, which leaves the suffixes that do repeat, and no text around them.
3. The suffixes that are left are grouped by the least hash among their
   ``ANCHOR``-byte substrings (equal suffixes choose the same one), and neighbours
   that share an occurrence of it travel as one context of at most
   ``CONTEXT`` bytes. Equal contexts of a chunk travel once, with the
   smallest doc_id.
4. The owner of a bucket ranks its contexts' cover sample, counted from the anchor, by
   the samples' ``SAMPLE`` bytes in order: the precomputed cover ranks. It then sorts
   the bucket's suffixes, those with the anchor at one offset at a time. Equal suffixes
   have the anchor at the same offset, so one shift puts all suffixes of a sort into the
   sample: they are compared by the bytes before it, then, where these tie, by the
   sample's rank in place of its bytes, and by the bytes behind. So a suffix takes
   ``KEY`` bytes and not ``WIDTH`` in a sort, and a sort holds one offset of one bucket.
   The owner answers for each context which of its suffixes start in a document with a
   smaller doc_id.
5. Each chunk marks the covered bytes.

The strings themselves are ranked and compared in step 4, so hashes decide nothing
alone. A passage that a third of all documents share costs one context per chunk. An
owner holds the questions of ``chunks.RANGE_BYTES`` of text packed and the contexts of
one bucket, ``chunks.BUCKET_BYTES`` of text, unpacked.

Edge cases: null texts are empty; texts shorter than ``WIDTH`` bytes lose nothing;
a very long text is one chunk and cut like any other; matches never cross documents,
and a document's own repeats stay; rows with the same doc_id don't match each other;
rows without doc_id come after all others and don't match each other; the doc_id 2^63-1 stands for a missing one and
comes back as null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import chunks as C
from .shingles import hash_powers, mixed
from .workspace import Workspace

WIDTH = 50
PERIOD = 21
#: A perfect difference set modulo 21: every residue but 0 is one difference of two members.
COVER = (3, 6, 7, 12, 14)
SAMPLE = WIDTH - PERIOD + 1
#: Bytes of an anchor, and how many anchors a string of WIDTH bytes may choose from.
ANCHOR = 20
CHOICES = WIDTH - ANCHOR + 1
CONTEXT = WIDTH + CHOICES - 1
#: Bytes of a suffix in a sort: a rank stands for a sample's bytes.
KEY = WIDTH - SAMPLE + 4
#: Bits beside the bucket that screen whole windows: one in a hundred that doesn't repeat passes.
WINDOW_BITS = 27
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Low bits of a hash that hold a position, to break ties to the left.
_PLACE_BITS = np.uint64(34)


class Rolling:
    """Hashes of a chunk's strings of any width, from one sum over its bytes."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        powers, self.inverse = hash_powers(self.size)
        self.total = np.zeros(self.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: self.size], out=self.total[1:])

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """64-bit hashes of ``width`` bytes from each position."""
        return mixed((self.total[at + width] - self.total[at]) * self.inverse[at])


def _sample(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a chunk and the text of each."""
    wanted = np.zeros(PERIOD, bool)
    wanted[list(COVER)] = True
    sizes = np.diff(chunk.starts)
    # The pattern of the longest text's sampled places serves all texts.
    places = np.flatnonzero(wanted[np.arange(max(0, int(sizes.max(initial=0)) - SAMPLE + 1)) % PERIOD])
    made = np.searchsorted(places, sizes - SAMPLE, "right")
    owner = np.repeat(np.arange(len(sizes)), made)
    at = chunk.starts[owner] + places[np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)]
    return at, owner


def _sample_keys(chunk: C.Chunk, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, doc_id) of each sampled suffix."""
    at, owner = _sample(chunk)
    return at, rolling.hashes(at, SAMPLE), chunk.ids[owner]


def _least(values: np.ndarray) -> np.ndarray:
    """Minima of each CHOICES neighbours, by doubling."""
    width = 1
    while 2 * width <= CHOICES:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = CHOICES - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _candidates(chunk: C.Chunk, rolling: Rolling, row, buckets: int) -> np.ndarray:
    """The suffixes with a tied sample among their first positions."""
    at, keys, places = _sample_keys(chunk, rolling)
    unique, bucket, index, _ = C.repeat_keys(keys, places, buckets)
    tied = at[C.repeat_flags(row.ranks, unique, bucket)[index]]
    size = len(chunk.data)
    if size < WIDTH or not len(tied):
        return np.zeros(0, np.int64)
    owner = np.searchsorted(chunk.starts, tied, "right") - 1
    first = np.maximum(chunk.starts[owner], tied - PERIOD + 1)
    last = np.minimum(tied, chunk.starts[owner + 1] - WIDTH)
    some = first <= last
    step = np.bincount(first[some], minlength=size + 1) - np.bincount(last[some] + 1, minlength=size + 1)
    return np.flatnonzero(np.cumsum(step[:size]) > 0)


def _window_keys(chunk: C.Chunk, rolling: Rolling, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the whole window, doc_id) of each suffix."""
    return rolling.hashes(suffix, WIDTH), chunk.ids[np.searchsorted(chunk.starts, suffix, "right") - 1]


def _contexts(chunk: C.Chunk, rolling: Rolling, suffix: np.ndarray):
    """(start, suffixes, anchor's offset, anchor's hash) of the contexts of these suffixes."""
    size = len(chunk.data)
    if not len(suffix):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    owner = np.searchsorted(chunk.starts, suffix, "right") - 1
    # Only strings below some suffix are hashed: their positions are packed, stretch by stretch.
    step = np.bincount(suffix, minlength=size + 1)
    step[: size + 1] -= np.bincount(np.minimum(suffix + WIDTH, size), minlength=size + 1)[: size + 1]
    used = np.flatnonzero(np.cumsum(step[:size]) > 0)
    packed = np.searchsorted(used, suffix)
    grams = rolling.hashes(np.minimum(used[: len(used) - ANCHOR + 1], size - ANCHOR), ANCHOR)
    tagged = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = _least(tagged)[packed]
    anchor = used[(least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)]
    new = np.ones(len(suffix), bool)
    new[1:] = (np.diff(suffix) != 1) | (np.diff(anchor) != 0) | (np.diff(owner) != 0)
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(suffix)])))
    # The least of many hashes is small: it is mixed again, so that buckets fill evenly.
    return suffix[at], count, anchor[at] - suffix[at], (least[at] >> _PLACE_BITS) * _MIX


def _records(chunk: C.Chunk, start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Contexts as fixed-width byte strings: text, offset of the anchor, number of suffixes.

    The last byte is never 0, so that comparing them as strings compares all bytes.
    """
    padded = np.concatenate((chunk.data, np.zeros(CONTEXT, np.uint8)))
    out = np.empty((len(start), CONTEXT + 2), np.uint8)
    out[:, :CONTEXT] = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[start]
    out[:, :CONTEXT][np.arange(CONTEXT) >= (count + WIDTH - 1)[:, None]] = 0
    out[:, CONTEXT], out[:, CONTEXT + 1] = offset + 1, count
    return out


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _cover_ranks(distinct: np.ndarray) -> np.ndarray:
    """Per context and place the rank of the sampled suffix that begins there, by its bytes; 0 where there is none.

    Places are counted from the anchor, so equal suffixes have their samples at equal places.
    """
    place = np.arange(CONTEXT)
    offset, end = distinct[:, CONTEXT].astype(np.int64)[:, None] - 1, distinct[:, CONTEXT + 1].astype(np.int64)[:, None] + WIDTH - 1
    sampled = np.isin((place - offset) % PERIOD, COVER) & (place + SAMPLE <= end)
    row, at = np.nonzero(sampled)
    flat = np.lib.stride_tricks.sliding_window_view(distinct.ravel(), SAMPLE)
    words = _words(flat[row * distinct.shape[1] + at])
    order = _in_order(words)
    new = _changes([w[order] for w in words])
    out = np.zeros((len(distinct), CONTEXT), np.uint32)
    out[row[order], at[order]] = np.cumsum(new)
    return out


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of numbers that compare as the bytes do."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _in_order(words: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(words[::-1])


def _changes(words: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    new = np.zeros(len(words[0]), bool)
    new[:1] = True
    for word in words:
        new[1:] |= word[1:] != word[:-1]
    return new


def _sort_suffixes(distinct: np.ndarray, first: np.ndarray, best: np.ndarray, contexts: np.ndarray) -> None:
    """Sort the contexts' suffixes and set the smallest doc_id of each equal run in ``best``.

    Equal suffixes have their anchor at the same offset, so each offset is sorted by itself.
    """
    if not len(contexts):
        return
    distinct, first = distinct[contexts], first[contexts]
    ranks = _cover_ranks(distinct)
    flat = np.lib.stride_tricks.sliding_window_view(distinct.ravel(), WIDTH)
    offset, count = distinct[:, CONTEXT].astype(np.int64) - 1, distinct[:, CONTEXT + 1].astype(np.int64)
    for ahead in range(CHOICES):
        step = offset - ahead
        index = np.flatnonzero((step >= 0) & (step < count))
        if not len(index):
            continue
        step = step[index]
        # The first shift that puts suffixes with the anchor so far ahead into the sample.
        shift = next(d for d in range(PERIOD) if (d - ahead) % PERIOD in COVER)
        text = flat[index * distinct.shape[1] + step]
        key = np.empty((len(index), KEY), np.uint8)
        key[:, :shift] = text[:, :shift]
        key[:, shift : shift + 4] = ranks[index, step + shift].astype(">u4").view(np.uint8).reshape(-1, 4)
        key[:, shift + 4 :] = text[:, shift + SAMPLE :]
        words = _words(key)
        order = _in_order(words)
        head = _changes([w[order] for w in words])
        least = np.minimum.reduceat(first[index][order], np.flatnonzero(head))
        best[contexts[index[order]], step[order]] = least[np.cumsum(head) - 1]


def _screened(questions: list[bytes]) -> tuple[list[bytes], int]:
    return C.repeat_answers(questions), 0


def _suffix_answers(bodies: list[bytes]) -> tuple[list[bytes], int]:
    """For each context a bit per suffix: it starts in a document with a smaller doc_id."""
    parts = [C.unpack(b, "u1", "i8") for b in bodies]
    rows = np.concatenate([r.reshape(-1, CONTEXT + 2) for r, _ in parts])
    ids = np.concatenate([i for _, i in parts])
    _, where, context = np.unique(_strings(rows), return_index=True, return_inverse=True)
    distinct = rows[where]
    first = np.full(len(distinct), C.NO_ID)
    np.minimum.at(first, context, ids)
    # A suffix occurs in one context only if its anchor's string has one context only.
    index, step = np.nonzero(np.arange(CHOICES) < distinct[:, CONTEXT + 1, None])
    best = np.full((len(distinct), CHOICES), C.NO_ID)
    best[index, step] = first[index]
    anchors = _strings(
        np.concatenate(
            (distinct[np.arange(len(distinct))[:, None], (distinct[:, CONTEXT] - 1)[:, None] + np.arange(ANCHOR)],
             np.ones((len(distinct), 1), np.uint8)),
            axis=1,
        )
    )
    _, anchor, contexts = np.unique(anchors, return_inverse=True, return_counts=True)
    _sort_suffixes(distinct, first, best, np.flatnonzero(contexts[anchor] > 1))
    bits = (best[context] < ids[:, None]) @ (np.uint32(1) << np.arange(CHOICES, dtype=np.uint32))
    cut = np.cumsum([len(i) for _, i in parts])[:-1]
    return [p.astype(np.uint32).tobytes() for p in np.split(bits, cut)], 0


def _covered(chunk: C.Chunk, row) -> np.ndarray:
    """Whether each byte goes."""
    size = len(chunk.data)
    if row.contexts is None:
        return np.zeros(size, bool)
    start, count, index, later = C.unpack(row.contexts, "u4", "u1", "u4", "u1")
    answers = [np.frombuffer(a["body"], np.uint32) for a in (row.masks if row.masks is not None else [])]
    mask = np.concatenate([*answers, np.zeros(0, np.uint32)])[index]
    mask = np.where(later.astype(bool), np.uint32(0xFFFFFFFF), mask)
    hit = ((mask[:, None] >> np.arange(CHOICES, dtype=np.uint32)) & 1).astype(bool)
    hit &= np.arange(CHOICES) < count[:, None]
    at = (start.astype(np.int64)[:, None] + np.arange(CHOICES))[hit]
    step = np.bincount(at, minlength=size + 1) - np.bincount(at + WIDTH, minlength=size + 1)[: size + 1]
    return np.cumsum(step[:size]) > 0


def removals(documents: DataFrame) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans in bytes."""
    space = Workspace(documents.sparkSession, "suffix-dedup")
    buckets = C.bucket_count(documents)

    def ask_sample(chunk: C.Chunk, row):
        _, keys, places = _sample_keys(chunk, Rolling(chunk.data))
        for b, _, body in C.repeat_questions(chunk.number, keys, places, buckets):
            yield b, body

    def ask_windows(chunk: C.Chunk, row):
        rolling = Rolling(chunk.data)
        keys, places = _window_keys(chunk, rolling, _candidates(chunk, rolling, row, buckets))
        for b, _, body in C.repeat_questions(chunk.number, keys, places, buckets, WINDOW_BITS):
            yield b, body

    table, _ = C.chunked(documents, space)
    table = table.drop("note")
    ranked, _ = C.exchanged(table, ask_sample, _screened, buckets, space, "ranks")
    repeated, _ = C.exchanged(ranked, ask_windows, _screened, buckets, space, "repeats")

    def ask_suffixes(chunk: C.Chunk, row):
        rolling = Rolling(chunk.data)
        suffix = _candidates(chunk, rolling, row, buckets)
        unique, bucket, index, _ = C.repeat_keys(*_window_keys(chunk, rolling, suffix), buckets, WINDOW_BITS)
        suffix = suffix[C.repeat_flags(row.repeats, unique, bucket)[index]]
        start, count, offset, hashed = _contexts(chunk, rolling, suffix)
        if not len(start):
            return
        rows = _records(chunk, start, count, offset)
        _, where, context = np.unique(_strings(rows), return_index=True, return_inverse=True)
        ids = chunk.ids[chunk.owners()[start]]
        first = np.full(len(where), C.NO_ID)
        np.minimum.at(first, context, ids)
        dealt = C.bucket_of(hashed[where], buckets)
        order = np.argsort(dealt, kind="stable")
        position = np.empty(len(order), np.uint32)
        position[order] = np.arange(len(order), dtype=np.uint32)
        for b, part in C.by_bucket(order, dealt[order]):
            chosen = order[part]
            yield b, C.pack(rows[where[chosen]], first[chosen])
        later = ids > first[context]
        yield C.NOTE, C.pack(start.astype(np.uint32), count.astype(np.uint8), position[context], later.astype(np.uint8))

    answered, _ = C.exchanged(repeated, ask_suffixes, _suffix_answers, buckets, space, "masks", "contexts")
    ready = answered.drop("ranks", "repeats")

    def cut(chunk: C.Chunk, row):
        gone = _covered(chunk, row)
        for number, at, until in zip(chunk.ids.tolist(), chunk.starts[:-1].tolist(), chunk.starts[1:].tolist()):
            mark = gone[at:until]
            removed = int(mark.sum())
            text = chunk.data[at:until]
            spans = []
            if removed:
                text = text[~mark]
                edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
                opens, shuts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(opens, shuts)]
            digest = hashlib.sha256(text.tobytes()).hexdigest()
            yield None if number == C.NO_ID else number, until - at, removed, len(spans), digest, spans

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = pd.DataFrame(list(cut(C.Chunk(row), row)), columns=names)
                yield out.astype({"doc_id": "Int64"})

    return ready.mapInPandas(run, RESULT)
