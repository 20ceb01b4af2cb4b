"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

Words are A-Z-lowered runs without ASCII white space; n-grams (orders 1 to 3) never
cross texts. The count tables hold all n-grams of all texts; those of order 2 and 3
need at least ``min_count`` occurrences to count as seen (1: all are). The score of a
word is

    count(w1 w2 w3) / count(w1 w2)       if w1 w2 w3 is seen, else
    BACKOFF * count(w2 w3) / count(w2)   if w2 w3 is seen, else
    BACKOFF ** 2 * count(w3) / words     if w3 is seen, else
    BACKOFF ** 3 / words

where a text's first words start at a lower order without a penalty for the orders
that they can't have. A text's score is the sum of the logarithms.

Counts are those of the other texts (``others``): a text's own n-grams are taken off the
tables' counts and its words off the number of words, so that no text is scored by itself
and what only it says backs off. Without ``others`` counts are those of all texts.

The plan is a join of exploded n-grams with hash-partitioned count tables, order by
order:

1. Explode and pre-aggregate. Each chunk lists its distinct n-grams (key, count).
2. Count tables. They are dealt by hash to the tables' owners: the owner of a bucket
   adds up its keys' counts, which is that bucket of the count table.
3. Join back. The table's rows are joined to the n-grams that asked for them, in the
   same bucket, and return to their chunks.
4. Sum per document.

Words and pairs are counted first. A triple that occurs twice consists of two pairs
that do, so only those triples are exploded into the second exchange; any other triple
that a text holds occurs once in all texts, and its count is 1 without being asked.

Tables and n-grams are packed columns, one row per bucket and batch of chunks. An
n-gram that all texts share is pre-aggregated per chunk; nothing is collected, so what
moves grows with the corpus and no faster.

N-grams are identified by their order and 62 bits of a hash. Edge cases: null and empty
texts have no words and the score 0; repeated rows count as often as they occur; rows
without doc_id are scored like others; the doc_id 2^63-1 stands for a missing one and
comes back as null; a very long text is one chunk, scored as a whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import chunks as C
from .shingles import mixed, word_counts, words
from .workspace import Workspace

BACKOFF = 0.4
RESULT = "doc_id long, n_words long, log_score double"

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a chunk: for each of its words the keys of the three that end there."""

    def __init__(self, chunk: C.Chunk):
        word, begin = words(chunk.data, chunk.starts)
        counts = word_counts(begin, chunk.starts[:-1])
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.keys, running = [], word
        for order in (1, 2, 3):
            if order > 1:
                before = np.concatenate((np.zeros(min(len(word), order - 1), np.uint64), word[: max(0, len(word) - order + 1)]))
                running = mixed(running * _MIX + before)
            # A key's low bits hold its order.
            self.keys.append((mixed(running + np.uint64(order)) & ~np.uint64(3)) | np.uint64(order))

    def own(self) -> list[np.ndarray]:
        """How often each word's n-grams occur in its text, by order."""
        out = []
        for order, keys in enumerate(self.keys):
            at = np.flatnonzero(self.place >= order)
            together = mixed(keys[at] + mixed(self.text[at].astype(np.uint64)))
            _, index, count = np.unique(together, return_inverse=True, return_counts=True)
            found = np.zeros(len(self.place), np.int64)
            found[at] = count[index]
            out.append(found)
        return out

    def low(self) -> Counted:
        """Words and pairs."""
        return Counted([(self.keys[0], np.arange(len(self.place))), (self.keys[1], np.flatnonzero(self.place >= 1))])

    def triples(self, pairs: np.ndarray) -> Counted:
        """The triples whose two pairs occur more than once, by the pairs' counts per word."""
        again = pairs > 1
        wanted = (self.place >= 2) & again
        wanted[1:] &= again[:-1]
        return Counted([(self.keys[2], np.flatnonzero(wanted))])


class Counted:
    """Distinct n-grams with their counts in a chunk, in order of key, and the words that they end at."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.parts = [at for _, at in parts]
        every = np.concatenate([keys[at] for keys, at in parts])
        self.unique, self.index, self.count = np.unique(every, return_inverse=True, return_counts=True)

    def questions(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        for bucket, at in C.by_bucket(self.unique, C.bucket_of(self.unique, buckets)):
            keys = C.pack_sorted(self.unique[at])
            yield bucket, len(keys).to_bytes(8, "little") + keys + C.pack_counts(self.count[at])

    def totals(self, answers, size: int, otherwise: int = 0) -> list[np.ndarray]:
        """The count tables' entries per part and word, joined in the order of the keys."""
        found = [C.unpack_counts(a["body"]) for a in (answers if answers is not None else [])]
        total = np.concatenate([*found, np.zeros(0, np.int64)])[self.index]
        out, begin = [], 0
        for at in self.parts:
            own = np.full(size, otherwise, np.int64)
            own[at] = total[begin : begin + len(at)]
            out.append(own)
            begin += len(at)
        return out


def count_table(questions: list[bytes]) -> tuple[list[bytes], int]:
    """A bucket of the count table, joined to the n-grams that asked; and the number of words in it."""
    grams = []
    for body in questions:
        cut = 8 + int.from_bytes(body[:8], "little")
        grams.append((C.unpack_sorted(body[8:cut]), C.unpack_counts(body[cut:])))
    keys, index = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
    counts = np.bincount(index, np.concatenate([n for _, n in grams])).astype(np.int64)
    joined = np.split(counts[index], np.cumsum([len(k) for k, _ in grams])[:-1])
    return [C.pack_counts(c) for c in joined], int(counts[(keys & np.uint64(3)) == 1].sum())


def _own_before(own: np.ndarray, grams: Grams, order: int) -> np.ndarray:
    """How often the n-gram that ends a word earlier occurs in the text, where there is one."""
    return np.where(grams.place >= order, np.roll(own, 1), 0)


def scores(documents: DataFrame, min_count: int = 1, others: bool = True) -> DataFrame:
    """doc_id, n_words, log_score: one row per input row."""
    space = Workspace(documents.sparkSession, "lm-scoring")
    buckets = C.bucket_count(documents)
    table, _ = C.chunked(documents, space)

    def ask_low(chunk: C.Chunk, row):
        return Grams(chunk).low().questions(buckets)

    def ask_triples(chunk: C.Chunk, row):
        grams = Grams(chunk)
        _, pairs = grams.low().totals(row.low, len(grams.place))
        return grams.triples(pairs).questions(buckets)

    counted, total = C.exchanged(table, ask_low, count_table, buckets, space, "low")
    ready, _ = C.exchanged(counted, ask_triples, count_table, buckets, space, "triples")

    def score(chunk: C.Chunk, row) -> pd.DataFrame:
        grams = Grams(chunk)
        text, place, size = grams.text, grams.place, len(grams.place)
        one, two = grams.low().totals(row.low, size)
        # A triple that wasn't asked for occurs here and nowhere else.
        three = np.where(place >= 2, grams.triples(two).totals(row.triples, size, 1)[0], 0)
        before, pair, elsewhere = np.roll(one, 1), np.roll(two, 1), np.full(size, total)
        if others:
            own = grams.own()
            before, pair = before - _own_before(own[0], grams, 1), pair - _own_before(own[1], grams, 2)
            one, two, three = one - own[0], two - own[1], three - own[2]
            elsewhere = total - np.bincount(text, minlength=len(chunk.ids))[text]
        use3 = (place >= 2) & (three >= min_count)
        use2 = ~use3 & (place >= 1) & (two >= min_count)
        value = BACKOFF ** np.minimum(place, 2) * np.where(one > 0, one, BACKOFF) / np.maximum(1, elsewhere)
        value = np.where(use2, BACKOFF ** (np.minimum(place, 2) - 1.0) * two / np.maximum(before, 1), value)
        value = np.where(use3, three / np.maximum(pair, 1), value)
        texts = len(chunk.ids)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(chunk.ids, dtype="Int64").mask(chunk.ids == C.NO_ID),
                "n_words": np.bincount(text, minlength=texts),
                "log_score": np.bincount(text, np.log(value), minlength=texts),
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield score(C.Chunk(row), row)

    return ready.mapInPandas(run, RESULT)
