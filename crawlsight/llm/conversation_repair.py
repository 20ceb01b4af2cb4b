"""Repair of conversation structure: the cheapest edits that make the roles legal.

Role initials must read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turns. Four grammar states (nothing yet, after s, after u, after a) carry
the least (cost, audit) forward through a conversation's rows, a Viterbi search whose
layers are the rows:

* Keep costs 0 and emits the row's own role, Rerole costs 1 and emits user or assistant,
  Delete costs 2 and is the only edit of blank and duplicate rows; a truncated row that
  isn't deleted costs 5 more;
* each layer, and the one before the first row, is closed by inserts of empty user or
  assistant turns at 5 each. Two are enough: a third returns to a state at a higher cost.

Of edits with equal cost those stay whose audit (initials of the edits in order) is least
by code point. Two audits of one state and cost never extend each other, since more
letters over the same rows are inserts, which cost more; so the least prefix stays least.

A row's first fault counts: blank (white space alone), duplicate (an earlier row of the
conversation has its role and text), truncated (the last other character is none of
``.!?``).

Plan: faults are found where the rows lie, duplicates by a window over digests, so the
search shuffles no texts. Rows are dealt by conversation and sorted within; a task reads
them in order and holds four short tails of audits and the audits' frozen beginnings, a
byte per row and state at most, so a conversation with a third of all rows needs no more
memory than its own audit. The texts are shuffled once, to be replayed by the audit in
order; a hash of the whole repaired text can't be split, so one task reads a
conversation's rows, as a stream.

Edge cases: null roles and texts are empty; an empty role has no initial and can't be
kept; rows go by turn (nulls first), then role, then the text's digest, so results don't
depend on the partitioning; repeated rows are duplicates; a null conv_id is a conversation
like others; texts of any length are handled whole; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import SPACE_CHARS

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A state's tail of an audit is frozen when every tail has this many letters.
FREEZE = 512
#: Inserted and reroled turns get one of these, by the state before them.
ROLES = ("user", "user", "assistant", "user")
#: The state that an initial leads to from each state; none where the grammar has no such step.
STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Rows a batch of results.
BATCH = 4096


def _path(path, cost: int, letter: str):
    total, rank, tail, frozen = path
    return (total + cost, rank, tail + letter, frozen)


def _best(*paths):
    return min((p for p in paths if p), key=lambda p: p[:3], default=None)


def _closed(layer: list) -> list:
    """The layer with up to two inserts after each path."""
    none, system, user, assistant = layer
    user = _best(user, *[_path(p, INSERT, "I") for p in (none, system, assistant) if p])
    return [none, system, user, _best(assistant, user and _path(user, INSERT, "I"))]


def _frozen(layer: list) -> list:
    """The layer with tails cut to a few letters; ranks keep the order of what is cut off."""
    cut = min(len(p[2]) for p in layer if p) - 4
    if cut < FREEZE - 4:
        return layer
    heads = sorted({(p[1], p[2][:cut]) for p in layer if p})
    rank = {head: i for i, head in enumerate(heads)}
    node = {(p[1], p[2][:cut]): (p[3], p[2][:cut]) for p in layer if p}
    return [p and (p[0], rank[head := (p[1], p[2][:cut])], p[2][cut:], node[head]) for p in layer]


class Viterbi:
    """The search over one conversation's rows, in order."""

    def __init__(self):
        self.layer = _closed([(0, 0, "", None), None, None, None])
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns = None, None, 0
        self.last = None

    def row(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        first, latest, distinct = self.turns
        if turn is not None:
            self.turns = turn if first is None else first, turn, distinct + (turn != latest)
        new = [[p and _path(p, DELETE, "D")] for p in self.layer]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault else 0
            for state, path in enumerate(self.layer):
                if path:
                    kept = STEPS.get(initial, STEPS["s"][1:] + (None,))[state]
                    if kept is not None:
                        new[kept].append(_path(path, extra, "K"))
                    new[3 if state == 2 else 2].append(_path(path, REROLE + extra, "R"))
        self.layer = _frozen(_closed([_best(*paths) for paths in new]))

    def result(self) -> dict:
        cost, _, tail, frozen = _best(self.layer[0], self.layer[3])
        parts = [tail]
        while frozen:
            frozen, part = frozen
            parts.append(part)
        first, latest, distinct = self.turns
        gaps = 0 if first is None else latest - first + 1 - distinct
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(reversed(parts))}


#: What ``plans`` gives beside the conversation.
MEASURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the text's digest, without nulls in role and text."""
    plain = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return plain.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _id_type(frame: DataFrame) -> str:
    return frame.schema["conv_id"].dataType.simpleString()


def plans(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation that has rows."""
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim("text", F.lit(SPACE_CHARS))
    rows = (
        _turns(conversations)
        .select(
            "conv_id",
            "turn",
            "role",
            "digest",
            (body == "").alias("blank"),
            (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
        )
        .withColumn("seen", F.row_number().over(same) > 1)
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("truncated"), "truncated")
    dealt = (
        rows.withColumn("fault", fault)
        .withColumn("initial", F.substring("role", 1, 1))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "seen")
        .select("conv_id", "turn", "initial", "fault")
    )
    id_type = dealt.limit(0).toArrow().schema.field("conv_id").type

    def batch(done: list) -> pa.RecordBatch:
        columns = [pa.array([c for c, _ in done], id_type)]
        columns += [pa.array([r[n] for _, r in done], t) for n, t in zip(_NAMES, _TYPES)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, search, at = [], None, None
        for part in batches:
            for conv_id, turn, initial, fault in zip(*[c.to_pylist() for c in part.columns]):
                if search is None or conv_id != at:
                    if search:
                        done.append((at, search.result()))
                    search, at = Viterbi(), conv_id
                search.row(turn, initial, fault)
                if len(done) == BATCH:
                    yield batch(done)
                    done = []
        if search:
            yield batch([*done, (at, search.result())])

    return dealt.mapInArrow(run, f"conv_id {_id_type(conversations)}, {MEASURES}")


def _with_plans(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """A conversation's plan and then its rows, in order, in one partition."""
    rows = _turns(conversations).withColumn("row", F.lit(True))
    plan = planned.select("conv_id", F.lit(False).alias("row"), *_NAMES)
    return (
        plan.unionByName(rows, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "digest")
        .drop("turn", "digest")
    )


class Replay:
    """Turns of one conversation, repaired by its audit as its rows come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _emit(self, role: str, text: str) -> tuple[str, str]:
        self.state = STEPS[role[0]][self.state]
        return role, text

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._emit(ROLES[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._emit(role if edit == "K" else ROLES[self.state], text)


def repaired_turns(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, n, role, text: the repaired turns; n counts from 0 in each conversation."""
    dealt = _with_plans(conversations, planned).select("conv_id", "row", "audit", "role", "text")
    id_type = dealt.limit(0).toArrow().schema.field("conv_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, at, n = None, None, 0
        for part in batches:
            out = []

            def put(turns):
                nonlocal n
                for role, text in turns:
                    out.append((at, n, role, text))
                    n += 1

            for conv_id, row, audit, role, text in zip(*[c.to_pylist() for c in part.columns]):
                if not row:
                    if replay:
                        put(replay.inserts())
                    replay, at, n = Replay(audit), conv_id, 0
                else:
                    put(replay.row(role, text))
            columns = list(zip(*out)) or [()] * 4
            types = (id_type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "n", "role", "text"])
        if replay and (left := list(replay.inserts())):
            columns = [pa.array([at] * len(left), id_type), pa.array(range(n, n + len(left)), pa.int64())]
            columns += [pa.array([t[i] for t in left], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "role", "text"])

    return dealt.mapInArrow(run, f"conv_id {_id_type(conversations)}, n long, role string, text string")


def repaired_digests(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """The columns of ``planned`` and repaired_sha256: of the repaired ``role:text``, joined by line ends."""
    dealt = _with_plans(conversations, planned).select("conv_id", "row", "role", "text", *_NAMES)
    id_type = dealt.limit(0).toArrow().schema.field("conv_id").type
    width = len(_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def feed(turns):
            for role, text in turns:
                now["hash"].update(f"{now['join']}{role}:{text}".encode())
                now["join"] = "\n"

        def close():
            feed(now["replay"].inserts())
            done.append((*now["plan"], now["hash"].hexdigest()))

        def batch() -> pa.RecordBatch:
            types = [id_type, *_TYPES, pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *_NAMES, "repaired_sha256"])

        for part in batches:
            for conv_id, row, role, text, *plan in zip(*[c.to_pylist() for c in part.columns]):
                if not row:
                    if now:
                        close()
                    now = {"plan": (conv_id, *plan), "replay": Replay(plan[width - 1]), "hash": hashlib.sha256(), "join": ""}
                else:
                    feed(now["replay"].row(role, text))
            if len(done) >= BATCH:
                yield batch()
                done = []
        if now:
            close()
            yield batch()

    return dealt.mapInArrow(run, f"conv_id {_id_type(conversations)}, {MEASURES}, repaired_sha256 string")
