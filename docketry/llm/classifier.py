"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text is two sequences: its words (A-Z lower-cased), and the shapes of its words
(letters, digits and other characters each as one class, runs as one character; a
word equal to the one before has a shape of its own). Their n-grams are hashed to
``2**bits`` buckets; a feature is the share of a bucket among the n-grams of the
text, so a score is a sparse dot product: the mean weight of the n-grams, plus a
bias, through the logistic function.

Training reads a bounded sample of the labelled rows: those whose id's hash is
below ``sample / labelled rows``, ``Training.sample`` rows on average whatever
the input. Their features are written once. Each of a fixed number of shards makes
per-coordinate FTRL-proximal updates example by example in the order of a hash of
the id, and the shards' states, whose size is fixed by ``bits``, are averaged by
examples before the next round (iterative parameter mixing). A lost task is run
again with the same order, so the model is the same.

Scoring is one pass over whole texts with the weights broadcast (4 bytes a bucket).

Defined results: null and empty texts have no n-grams, so their score is that of
the bias; labels that are null, and labels without a document, are left out; of
several labels of an id the mean counts, from one half on as 1; without any label
every score is one half; repeated rows and null ids are scored row by row; an empty
table gives an empty result; other columns are not read, so their names are free.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import Words, materialize, mix, narrow, slices
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)


@dataclass(frozen=True)
class Training:
    """Features, sample and learning rates."""

    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    shapes: tuple[int, ...] = (1, 2, 3)
    scale: float = 8.0  # of a share, so that weights stay small
    sample: int = 16_384
    shards: int = 8
    rounds: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-4


@dataclass
class Model:
    """``weights`` has one value a bucket and the bias last."""

    training: Training
    weights: np.ndarray = field(repr=False)


_KINDS = bytes(
    0x61 if chr(b).islower() and b < 128 else 0x41 if chr(b).isupper() and b < 128 else 0x30 if 0x30 <= b <= 0x39 else 0x80 if b > 127 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def _shape(word: bytes) -> bytes:
    return _RUN.sub(rb"\1", word.translate(_KINDS))


def ngrams(texts: pa.Array, training: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram occurrence, and the number of n-grams of each row."""
    words = Words(texts)
    distinct = words.distinct.cast(pa.binary()).to_pylist()
    plain = np.fromiter((zlib.crc32(w.lower()) for w in distinct), np.uint64, len(distinct))
    shape = np.fromiter((zlib.crc32(_shape(w)) for w in distinct), np.uint64, len(distinct))
    again = np.zeros(len(words.doc), bool)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1])
    sequences = (
        (plain[words.codes], training.words),
        (np.where(again, np.uint64(1 << 32), shape[words.codes]), training.shapes),
    )
    rows, buckets, mask = [], [], np.uint64((1 << training.bits) - 1)
    for kind, (values, lengths) in enumerate(sequences):
        for n in lengths:
            count = max(len(values) - n + 1, 0)
            key = np.full(count, 16 * kind + n, np.uint64)
            for k in range(n):
                key = mix(key ^ values[k : k + count])
            inside = words.doc[:count] == words.doc[n - 1 :] if count else np.zeros(0, bool)
            rows.append(words.doc[:count][inside])
            buckets.append((key[inside] & mask).astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    return row, bucket, np.bincount(row, minlength=len(texts))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    row, bucket, total = ngrams(texts, model.training)
    sums = np.bincount(row, weights=model.weights[bucket], minlength=len(texts))
    return _logistic(model.training.scale * sums / np.maximum(total, 1) + model.weights[-1])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """FTRL-proximal, one example at a time: ``z`` and the sums of squared gradients."""

    def __init__(self, training: Training, z: np.ndarray, squares: np.ndarray):
        self.training, self.z, self.squares, self.seen = training, z, squares, 0

    def weights(self, at) -> np.ndarray:
        t, z = self.training, self.z[at]
        w = -(z - np.sign(z) * t.l1) / ((t.beta + np.sqrt(self.squares[at])) / t.alpha + t.l2)
        return np.where(np.abs(z) <= t.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        """``at`` holds each bucket once."""
        w = self.weights(at)
        gradient = (_logistic(w @ value) - label) * value
        before = self.squares[at]
        after = before + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.training.alpha * w
        self.squares[at] = after
        self.seen += 1


def _examples(training: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, bucket, total = ngrams(batch.column(1).cast(pa.string()), training)
            order = np.lexsort((bucket, row))
            cuts = np.concatenate(([0], np.cumsum(total)))
            at, value = [], []
            for k in range(batch.num_rows):
                found, count = np.unique(bucket[order[cuts[k] : cuts[k + 1]]], return_counts=True)
                at.append(np.append(found, 1 << training.bits).astype(np.uint32).tobytes())
                value.append(np.append(training.scale * count / max(total[k], 1), 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["id", "label", "at", "value"]
            )

    return run


def _passing(training: Training, state):
    """One pass over the examples of a shard; the state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(training, *(x.astype(np.float64) for x in state.value))
        for batch in batches:
            for at, value, label in zip(*(batch.column(k) for k in range(3))):
                leader.learn(np.frombuffer(at.as_buffer(), np.uint32), np.frombuffer(value.as_buffer(), np.float32).astype(np.float64), label.as_py())
        if leader.seen:
            both = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (leader.z, leader.squares)]
            yield pa.RecordBatch.from_arrays([pa.array([leader.seen]), *both], names=["seen", "z", "squares"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    training: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn from the labelled documents; ``labels`` holds ids and 0 or 1."""
    spark = docs.sparkSession
    given = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("of"), F.col(f"`{label_col}`").cast("double").alias("label"))
        .where("of is not null and label is not null")
        .groupBy("of").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    share = min(1.0, training.sample / max(given.count(), 1))
    place = F.pmod(F.xxhash64("of", F.lit(11)), F.lit(1 << 32))
    # the sample's size is fixed by the parameter: 16 bytes a row
    chosen = F.broadcast(given.where(place < int(share * (1 << 32)))) if share < 1 else F.broadcast(given)
    joined = narrow(docs, id_col, text_col).join(chosen, F.col("id") == F.col("of")).select("id", "text", "label")
    examples = materialize(joined.mapInArrow(_examples(training), "id long, label double, at binary, value binary"), "examples")
    dealt = (
        examples.withColumn("turn", F.xxhash64("id", F.lit(13)))
        .repartition(training.shards, F.pmod("turn", F.lit(training.shards)))
        .sortWithinPartitions("turn", "id", "label", "at", "value")
        .select("at", "value", "label")
    )
    size = (1 << training.bits) + 1
    state = (np.zeros(size, np.float32), np.zeros(size, np.float32))
    for _ in range(training.rounds):
        shared = spark.sparkContext.broadcast(state)
        # one row a shard, whose size the number of buckets fixes
        made = dealt.mapInArrow(_passing(training, shared), "seen long, z binary, squares binary").collect()
        shared.unpersist()
        seen = sum(r.seen for r in made)
        if not seen:
            break
        state = tuple(
            sum((np.frombuffer(r[name], np.float32) * np.float64(r.seen / seen) for r in sorted(made)), np.zeros(size)).astype(np.float32)
            for name in ("z", "squares")
        )
    leader = Leader(training, *(x.astype(np.float64) for x in state))
    return Model(training, leader.weights(np.arange(size)).astype(np.float32))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, score``. No shuffle."""
    training, shared = model.training, docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(training, shared.value)
        for batch in slices(batches, 1):
            found = scores(batch.column(1).cast(pa.string()), held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "score"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, score double")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The buckets with a weight, as a table."""
    at = np.flatnonzero(model.weights)
    table = pa.table({"bucket": at, "weight": model.weights[at]})
    spark.createDataFrame(table).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str, training: Training = Training()) -> Model:
    """A saved model; ``training`` is the one it was made with."""
    weights = np.zeros((1 << training.bits) + 1, np.float32)
    table = spark.read.parquet(path).toArrow()  # a row a bucket at most
    weights[table["bucket"].to_numpy()] = table["weight"].to_numpy()
    return Model(training, weights)
