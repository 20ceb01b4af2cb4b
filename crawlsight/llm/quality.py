"""Quality classifier: supervised subword embeddings, trained by numpy gradient descent.

A document is a bag of hashed features: words, pairs of neighbouring words and
character n-grams of bytes, plus the shape of each word (its character classes,
and whether it repeats one of the words before it), which are words of a second,
coarser vocabulary. Each family of features is averaged on its own, so a text's
many character n-grams don't drown its words. Each feature has a learned vector;
a document is the mean of its features' vectors; a softmax over two classes
gives the score. Hash features need no vocabulary, so the model has a fixed size
(``BUCKETS`` x ``DIM`` floats) at any scale.

Scoring folds the softmax weights into the vectors: the difference of the two
class scores is linear in the mean vector, so one float per bucket is enough.
That table (1 MB) is what the executors get. One task trains on the bounded sample, so
the driver holds neither texts nor features.

Training takes at most ``max_train_docs`` labelled rows (those with the smallest
hash of doc_id, whatever the table's size) with their whole texts, and of these as many
as hold ``max_train_bytes``; a text of more than a hundredth of that is not learnt
from. Scoring covers all rows and whole texts. Labels, lang, source and doc_id are
never inputs.

Edge cases: null texts are empty; empty texts score by the bias alone; very long texts
are scored as a whole; several labels of one doc_id count as their largest; null labels
are ignored; with no labelled rows every score is 0.5, and with one class only the bias
moves; an empty table gives an empty result; repeated rows and rows without doc_id are
scored like others; extra columns are returned as they are, but for one named ``score``,
which ``score`` replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .chunks import pack, unpack

BUCKETS = 1 << 18
DIM = 8
#: Bytes of text that are turned into features at a time, if no single text is longer.
BATCH_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Families of features and the weight of each in a document's mean.
FAMILIES = ("word", "pair", "shape", "shape pair", "char 3", "char 5")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Bucket numbers of 64-bit hashes."""
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _MIX
    x = (x ^ (x >> _S29)) * _MIX
    return (x >> _S32).astype(np.int64) & (BUCKETS - 1)


#: Class of each byte: blank, lower, upper, digit, beyond ASCII, and 8 classes of signs.
_CLASS = np.array(
    [
        0
        if b in b" \t\n\x0b\x0c\r"
        else 1
        if 97 <= b <= 122
        else 2
        if 65 <= b <= 90
        else 3
        if 48 <= b <= 57
        else 4
        if b >= 128
        else 5 + b % 8
        for b in range(256)
    ],
    np.uint8,
)


def features(data: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) arrays, one pair per family, of a byte array whose texts are divided by blanks."""
    n = len(data)
    kind = _CLASS[data]
    solid = kind != 0
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.cumprod(np.full(n + 1, 0x100000001B3, np.uint64))
    inverse = np.cumprod(np.full(n + 1, pow(0x100000001B3, -1, 1 << 64), np.uint64))

    def spans(codes: np.ndarray) -> np.ndarray:
        total = np.concatenate(([np.uint64(0)], np.cumsum(codes.astype(np.uint64) * powers[:n])))
        return (total[end] - total[start]) * inverse[start]

    word, of = spans(data.astype(np.uint64) + np.uint64(1)), owner[start]
    yield of, _mixed(word, 1)
    same = of[1:] == of[:-1]
    yield of[1:][same], _mixed((word[:-1] * _MIX + word[1:])[same], 2)
    again = np.zeros(len(word), np.uint64)
    for back in (1, 2, 3):
        again[back:] |= ((word[back:] == word[:-back]) & (of[back:] == of[:-back])).astype(np.uint64) << np.uint64(back)
    first, last = kind[start].astype(np.uint64), kind[end - 1].astype(np.uint64) if len(end) else kind[start].astype(np.uint64)
    upper = np.concatenate(([0], np.cumsum(kind == 2)))
    letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2) | (kind == 4))))
    size = (end - start).astype(np.uint64)
    loud = ((upper[end] - upper[start]) > 1).astype(np.uint64)
    signs = np.minimum(size - (letters[end] - letters[start]).astype(np.uint64), np.uint64(4))
    shape = ((((first * np.uint64(16) + last) * np.uint64(16) + again) * np.uint64(2) + loud) * np.uint64(8) + signs)
    yield of, _mixed(shape, 3)
    yield of[1:][same], _mixed((shape[:-1] * _MIX + shape[1:])[same], 4)
    for salt, width in ((5, 3), (6, 5)):
        if n < width:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        gram = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            gram = (gram << np.uint64(8)) | data[i : n - width + 1 + i]
        inside = owner[: n - width + 1] == owner[width - 1 :]
        yield owner[: n - width + 1][inside], _mixed(gram, salt)[inside]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return data, owner


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        until, held = at, 0
        while until < len(texts) and (until == at or held + len(texts[until]) <= BATCH_BYTES):
            held += len(texts[until])
            until += 1
        yield at, texts[at:until]
        at = until


class Model:
    """Vectors per bucket, softmax weights and bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
        self.weights = rng.normal(0, 1 / DIM, (DIM, 2))
        self.bias = np.zeros(2)

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their weights in the document's mean."""
        found, shares = [], []
        for of, bucket in features(*_joined([text])):
            index, count = np.unique(bucket, return_counts=True)
            found.append(index)
            shares.append(count / max(1, len(bucket)) / len(FAMILIES))
        return np.concatenate(found).astype(np.int32), np.concatenate(shares).astype(np.float32)

    def held(self, text: bytes) -> bytes:
        """The bag as it waits for its steps: shares are few different values and pack well."""
        return pack(*self.bag(text))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 4, rate: float = 4.0, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        bags = [self.held(t) for t in texts]
        target = np.eye(2)[labels.astype(int)]
        counts = target.sum(axis=0)
        self.bias = np.log((counts + 1) / (counts.sum() + 2))
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                index, share = unpack(bags[i], "i4", "f4")
                mean = share @ self.vectors[index]
                score = mean @ self.weights + self.bias
                score = np.exp(score - score.max())
                error = score / score.sum() - target[i]
                now = rate * (1 - done / steps)
                back = self.weights @ error
                self.weights -= 0.05 * now * np.outer(mean, error)
                self.bias -= 0.01 * now * error
                self.vectors[index] -= now * np.outer(share, back)
                done += 1
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """Per bucket and for the bias: the score of class 1 less that of class 0."""
        slope = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ slope).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_texts(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for at, part in _batches(texts):
        data, owner = _joined(part)
        for of, bucket in features(data, owner):
            total = np.bincount(of, weights=table[bucket], minlength=len(part))
            count = np.bincount(of, minlength=len(part))
            out[at : at + len(part)] += total / np.maximum(1, count) / len(FAMILIES)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(documents: DataFrame, labels: DataFrame, max_train_docs: int = 5000, max_train_bytes: int = 256 << 20) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_train_docs`` rows of ``labels`` (doc_id, quality), with whole texts of ``max_train_bytes`` in all.

    Repeated rows are learnt from once. No task gathers texts beyond that size, however long the labelled ones are.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train_docs)
    )
    place = (F.xxhash64("doc_id"), "doc_id", "digest")
    labelled = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    labelled = labelled.withColumns({"digest": F.sha2("text", 256), "size": F.octet_length("text").cast("long")})
    # Sizes are bounded before any text is moved; the window is over max_train_docs narrow rows, which the limit has gathered already.
    sizes = labelled.where(F.col("size") <= max_train_bytes // 100).select("doc_id", "digest", "size").distinct().orderBy(*place).limit(max_train_docs)
    held = F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = sizes.withColumn("held", held).where(F.col("held") <= max_train_bytes).select("doc_id", "digest")
    rows = labelled.join(F.broadcast(taken), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rows = rows.repartition(1).sortWithinPartitions(*place).select("text", "quality")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += [t.encode() for t in batch.column("text").to_pylist()]
            known += [int(q == 1) for q in batch.column("quality").to_pylist()]
        if texts:
            table, bias = Model().fit(texts, np.array(known)).table()
            yield pa.RecordBatch.from_pydict({"weights": [pack(table)], "bias": [bias]})

    # One task has the whole sample, which is bounded; the driver gets the weights.
    found = rows.mapInArrow(fit, "weights binary, bias double").first()
    if found is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return unpack(bytes(found["weights"]), "f4")[0], found["bias"]


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of ``documents`` except text, and ``score``."""
    table, bias = model
    held = documents.sparkSession.sparkContext.broadcast(table)
    frame = documents.withColumn("text", F.coalesce("text", F.lit("")))
    rest = [f for f in frame.schema.fields if f.name not in ("text", "score")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            scores = pa.array(score_texts(texts, held.value, bias), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], scores], [*names, "score"])

    schema = StructType([*rest, StructField("score", DoubleType())])
    return frame.select("text", *names).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with their columns."""
    model = train(documents, labels.where(~held_out()))
    table, bias = model
    held = documents.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts([t.encode() if t else b"" for t in texts], held.value, bias))

    return documents.where(scored("text") >= threshold)
