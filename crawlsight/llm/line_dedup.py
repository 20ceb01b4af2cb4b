"""Near-duplicate lines by an exact set-similarity join with prefix filters.

A line's tokens are its distinct five-word shingles (the whole sequence of a line
with fewer words). A line goes if an earlier line, in order of (doc_id, line
number), has a Jaccard similarity of at least ``percent``; lines are judged on the
input, so a line that goes still removes later ones. Lines without words stay.

Two lines of n and m tokens that are similar enough share one of their first
n - ceil(percent * n) + 1 tokens, whatever total order all lines' tokens are in.

1. Screening. In the order of the tokens' hashes, a packed exchange tells which prefix
   tokens another line has. Of a prefix that is longer by m tokens a similar line has
   at least m + 1 (m is 0 above 87 percent, where this wouldn't hold); lines with fewer
   shared ones are alone and move no further.
2. Classes. Equal lines form one class with its first place.
3. Join. The classes' tokens are put in order of rarity: they are counted in a table
   of fixed size (``SLOTS`` counters), so the order is by (count, hash) and what is
   broadcast has a bound. Classes meet on prefix tokens that another class has, under
   the length and the positional filter, and are verified on all tokens. First each
   token's classes are compared with its earliest class; only those that this doesn't
   remove are compared with the other earlier ones. Whether a class goes takes one
   earlier match, so nothing is lost.
4. Each class's first place and verdict return to the chunks, which cut the lines.

Edge cases: null texts are empty; an empty text has one line without words; a line
ends with the character 10; rows with the same doc_id are ordered by line number and,
where that ties, both stay; rows without doc_id come last;
the doc_id 2^63-1 stands for a missing one and
comes back as null; an empty table gives an
empty result; a very long text, of any number of lines, is one chunk and judged as a
whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .packed_sets import BUCKET_KEYS, SetRow, each_row, key_flags, pack_sets, shared_keys
from .shingles import shingle_sets, word_counts, words
from .workspace import Workspace

SLOTS = 1 << 17
#: Bytes that are broadcast at most, and bytes that a class's name or place takes; beyond it rows are shuffled.
BROADCAST_BYTES, NAME_BYTES = 32 << 20, 64
#: A class with more than one of so many rows is hot; so there are fewer hot classes than this.
HOT_SHARE = 1000
RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string, removed_lines array<long>"
_SHIFT = np.uint64(40)


def line_bounds(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every line of a chunk, in order."""
    breaks = np.flatnonzero(chunk.data == 10)
    owner = np.searchsorted(chunk.starts, breaks, "right") - 1
    texts = np.arange(len(chunk.ids))
    # A text's first line begins with it, the others after a break; the last ends with the text.
    begin = np.concatenate((chunk.starts[:-1], breaks + 1))
    end = np.concatenate((breaks, chunk.starts[1:]))
    order = np.lexsort((begin, np.concatenate((texts, owner))))
    last = np.lexsort((end, np.concatenate((owner, texts))))
    return begin[order], end[last], np.concatenate((texts, owner))[order]


def prefix_sizes(counts: np.ndarray, percent: int, longer: np.ndarray | int = 0) -> np.ndarray:
    return np.where(counts > 0, counts + (-counts * percent // 100) + 1 + longer, 0)


def _longer(counts: np.ndarray, percent: int) -> np.ndarray:
    """Tokens by which the screened prefixes are longer than they must be: a tenth of the line's, or none.

    Lines of n > m tokens with o in common share o - ceil(t * m) + m // 10 + 1 of both
    prefixes at least, and n // 10 + 1 are asked for. As o >= t * (n + m) / (1 + t), that is
    enough where (t * d + t * (1 - t) * m) / (1 + t) >= n // 10 - m // 10 for d = n - m:
    for d <= 10 (where n >= 10 and 1 is needed) if 9 * t * (1 - t) >= 1, so from 0.13 to
    0.87, and for d > 10 if t / (1 + t) >= 2 / 11, so from 0.23 on. With prefixes that are
    not longer, one token is shared at any threshold.
    """
    return counts // 10 if 23 <= percent <= 87 else np.zeros_like(counts)


def tokens_of(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number per line) of lines that begin at these places of ``data``, in order of hash."""
    word, at = words(data, begin)
    return shingle_sets(word, word_counts(at, begin))


def _prefixes(tokens: np.ndarray, counts: np.ndarray, percent: int, longer: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, rank) of the first tokens of each set."""
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted = rank < prefix_sizes(counts, percent, longer)[owner]
    return tokens[wanted], owner[wanted], rank[wanted]


def _class(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def token_counts(sets: DataFrame) -> np.ndarray:
    """How often the tokens of each slot occur in all sets: SLOTS numbers, whatever the input's size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                total += np.bincount(_slot(SetRow(row).values), minlength=SLOTS)
        yield pd.DataFrame({"part": range(16), "body": [C.pack(p) for p in np.split(total, 16)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(C.unpack(b, "i8")[0] for b in group["body"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "body": [C.pack(total)]})

    partial = sets.mapInPandas(count, "part long, body binary")
    # Tasks are added up in groups first, so that no task meets all tasks' tables.
    spread = partial.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(64)).alias("some"))
    some = spread.applyInPandas(add, "part long, body binary")
    rows = some.groupBy("part").applyInPandas(add, "part long, body binary").orderBy("part").collect()
    return np.concatenate([C.unpack(r["body"], "i8")[0] for r in rows]) if rows else np.zeros(SLOTS, np.int64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _SHIFT).astype(np.int64) & (SLOTS - 1)


def _candidates(documents: DataFrame, percent: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The chunks, and (chunk, class, doc_id, line, tokens, lines): the lines that may match, by class and chunk.

    doc_id and line are the class's first place in the chunk; lines packs the
    numbers of all its lines there.
    """
    buckets = C.bucket_count(documents)

    def ask(chunk: C.Chunk):
        begin, _, _ = line_bounds(chunk)
        tokens, sizes = tokens_of(chunk.data, begin)
        tokens, owner, _ = _prefixes(tokens, sizes, percent, _longer(sizes, percent))
        unique, bucket, order, held_by, many = C.ranked_keys(tokens, owner, buckets)
        yield from C.key_questions(chunk.number, unique, bucket, many)
        if len(unique):
            held = np.array([(b, at.stop - at.start) for b, at in C.by_bucket(unique, bucket)])
            yield (
                C.NOTE,
                chunk.number,
                C.pack(
                    owner[order].astype(np.uint32),
                    held_by.astype(np.uint32),
                    held.astype(np.int64),
                    (_longer(sizes, percent) + 1).astype(np.uint32),
                ),
            )

    table, questions = C.chunked(documents, space, ask)
    answers = space.write(C.answered(questions, C.repeat_answers), "answers", "none")
    C.drop_questions(space)

    def found(chunk: C.Chunk, row):
        if row.note is None:
            return
        owner, counts, held, needed = C.unpack(row.note, "u4", "u4", "i8", "u4")
        bodies = {int(a["bucket"]): a["body"] for a in row.answers}
        flags = [np.unpackbits(np.frombuffer(bodies[b], np.uint8), count=n) for b, n in held.reshape(-1, 2).tolist()]
        shared = owner[np.repeat(np.concatenate(flags).astype(bool), counts)]
        hit = np.flatnonzero(np.bincount(shared, minlength=len(needed)) >= needed)
        begin, end, text = line_bounds(chunk)
        number = np.arange(len(begin)) - np.searchsorted(text, text, "left")
        begin, end = begin[hit], end[hit]
        size = end - begin
        at = np.cumsum(size) - size
        data = chunk.data[np.repeat(begin - at, size) + np.arange(int(size.sum()))]
        tokens, counts = tokens_of(data, at)
        cut = np.cumsum(counts) - counts
        seen: dict[bytes, list] = {}
        for i, (line, first, n) in enumerate(zip(hit.tolist(), cut.tolist(), counts.tolist())):
            seen.setdefault(_class(tokens[first : first + n]), []).append((int(chunk.ids[text[line]]), int(number[line]), line, i))
        for name, places in seen.items():
            doc_id, line, _, i = min(places)
            own_tokens = tokens[cut[i] : cut[i] + counts[i]].view(np.int64)
            lines = np.array([p[2] for p in places], np.uint32)
            yield chunk.number, name, doc_id, line, own_tokens, lines.tobytes()

    schema = "chunk long, class binary, doc_id long, line long, tokens array<long>, lines binary"
    return table.drop("note"), space.write(C.asked(C.returned(table, answers, "answers"), found, schema), "found")


def _postings(classes: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """(class, n, pos, token): the classes' rarest tokens, those that another class has too."""
    table = pack_sets(classes.select("class", "tokens"), space, "class-sets")
    counts = classes.sparkSession.sparkContext.broadcast(token_counts(table))
    total = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))

    def rare(part: SetRow):
        order = np.lexsort((part.values, counts.value[_slot(part.values)], part.owner))
        return _prefixes(part.values[order], part.counts, percent)

    def listed(part: SetRow, row):
        tokens, owner, rank = rare(part)
        hit = key_flags(row, tokens, owner, buckets)
        names = part.name_list()
        yield [names[i] for i in owner[hit].tolist()], part.counts[owner[hit]], rank[hit], tokens[hit].view(np.int64)

    ready = shared_keys(table, lambda part: rare(part)[:2], buckets, space, "class-answers")
    return each_row(ready, listed, "class binary, n long, pos long, token long")


def _may_match(n: Column, pos: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Length and positional filters of two sets that share the tokens at these ranks.

    Neither has an earlier token in common if this is the first; if it is not, the
    first one passes the filter by itself.
    """
    shared = F.least(n - pos, n_b - pos_b)
    return (100 * F.least(n, n_b) >= percent * F.greatest(n, n_b)) & (100 * shared >= percent * (n + n_b - shared))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int, space: Workspace, name: str) -> DataFrame:
    """The classes of written pairs (class, other) with a similar enough other."""
    some = pairs.select("class").union(pairs.select("other")).distinct()
    if 2 * NAME_BYTES * pairs.count() <= BROADCAST_BYTES:
        some = F.broadcast(some)
    tokens = space.write(classes.select("class", "tokens").join(some, "class", "left_semi"), f"{name}-tokens")
    other = tokens.select(F.col("class").alias("other"), F.col("tokens").alias("other_tokens"))
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    union = F.size("tokens") + F.size("other_tokens") - shared
    similar = pairs.join(tokens, "class").join(other, "other").where(100 * shared >= percent * union)
    return similar.select("class").distinct()


def removed_lines(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Per input row: doc_id, n_lines, n_removed, kept_sha256 and the numbers of the removed lines (from 0)."""
    space = Workspace(documents.sparkSession, "line-dedup")
    table, found = _candidates(documents, percent, space)
    classes = found.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("place"), F.first("tokens").alias("tokens"))
    classes = space.write(classes, "classes")
    found = space.write(found.drop("tokens"), "places")
    space.drop("found")
    postings = _postings(classes, percent, space).join(classes.select("class", "place"), "class")
    postings = space.write(postings, "postings")
    space.drop("class-sets")
    earliest = postings.groupBy("token").agg(F.min(F.struct("place", "class", "n", "pos")).alias("e"))
    filed = space.write(postings.join(earliest, "token").where(F.col("e.class") != F.col("class")), "filed")
    pivots = (
        filed.where(_may_match(F.col("n"), F.col("pos"), F.col("e.n"), F.col("e.pos"), percent))
        .select("class", F.col("e.class").alias("other"))
        .distinct()
    )
    gone = space.write(_verified(space.write(pivots, "pivots"), classes, percent, space, "pivot"), "gone")
    # What an earliest class doesn't remove meets the other earlier classes of its tokens.
    other = filed.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "place", "n", "pos")])
    pairs = (
        filed.join(gone, "class", "left_anti")
        .join(other, "token")
        .where(F.col("place_b") < F.col("place"))
        .where(_may_match(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent))
        .select("class", F.col("class_b").alias("other"))
        .distinct()
    )
    rest = _verified(space.write(pairs, "pairs"), classes, percent, space, "pair")
    gone = gone.union(rest).withColumn("echo", F.lit(True))
    verdicts = classes.join(gone, "class", "left").select("class", "place", F.coalesce("echo", F.lit(False)).alias("echo"))
    first = (F.col("place.doc_id") == F.col("doc_id")) & (F.col("place.line") == F.col("line")) & (F.length("lines") == 4)
    verdicts = space.write(verdicts, "verdicts")
    # A line of very many chunks has a row in each: such classes meet their rows by a broadcast.
    rows = found.count()
    held = found.groupBy("class").agg(F.count("*").alias("held")).where(F.col("held") > max(1, rows // HOT_SHARE))
    hot = F.broadcast(space.write(held.select("class"), "hot"))
    told = (
        found.join(F.broadcast(verdicts.join(hot, "class", "left_semi")), "class")
        .unionByName(found.join(hot, "class", "left_anti").join(verdicts, "class"))
        .where(F.col("echo") | ~first)  # a line that comes first and alone stays
        .select("chunk", "lines", F.col("place.doc_id").alias("doc_id"), F.col("place.line").alias("line"), "echo")
    )
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("lines", "doc_id", "line", "echo")).alias("verdicts"))
    told = space.write(told, "told")
    size = told.agg(F.sum(F.aggregate("verdicts", F.lit(0), lambda n, v: n + F.length(v["lines"]) + NAME_BYTES))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        told = F.broadcast(told)

    def cut(chunk: C.Chunk, row) -> Iterator[tuple]:
        begin, end, text = line_bounds(chunk)
        number = np.arange(len(begin)) - np.searchsorted(text, text, "left")
        removed = np.zeros(len(begin), bool)
        for verdict in row.verdicts if row.verdicts is not None else []:
            lines = np.frombuffer(verdict["lines"], np.uint32).astype(np.int64)
            ids = chunk.ids[text[lines]]
            later = (ids > verdict["doc_id"]) | ((ids == verdict["doc_id"]) & (number[lines] > verdict["line"]))
            removed[lines[later | verdict["echo"]]] = True
        bounds = np.searchsorted(text, np.arange(len(chunk.ids) + 1))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            mark = removed[a:b]
            if mark.any():
                kept = [chunk.data[x:y].tobytes() for x, y, m in zip(begin[a:b], end[a:b], mark) if not m]
                body = b"\n".join(kept)
            else:
                body = chunk.data[chunk.starts[i] : chunk.starts[i + 1]].tobytes()
            doc_id = int(chunk.ids[i])
            yield (
                None if doc_id == C.NO_ID else doc_id,
                b - a,
                int(mark.sum()),
                hashlib.sha256(body).hexdigest(),
                np.flatnonzero(mark).tolist(),
            )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_lines", "n_removed", "kept_sha256", "removed_lines"]
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame(list(cut(C.Chunk(row), row)), columns=names).astype({"doc_id": "Int64"})

    return table.join(told, "chunk", "left").mapInPandas(run, RESULT)
