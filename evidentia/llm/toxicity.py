"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the distinct terms of a text.
The pairwise part, computed as half of (sum)^2 - (sum of squares) for each factor, learns combinations
that additive weights miss.

Terms are lower-cased words and their first four and five letters (inflected insults share a stem),
hashed to `BUCKETS` buckets.  A bucket is kept if `LEAST_ROWS` rows of the sample have it, whatever their labels:
a term may matter only beside another.  The value x_i of a term is its rarity, log(rows / rows with it) over log(rows),
and at least `LEAST_VALUE`.

Fit on at most `MAX_TOXIC` + `MAX_CLEAN` labelled rows (the documented bound), chosen by a hash of the id;
the texts of those rows are turned to bucket lists on the executors.  Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table, unused, utf8

BUCKETS = 1 << 20
MAX_TOXIC, MAX_CLEAN = 2_500, 12_500
#: Rows of the sample that a kept bucket is in at least.
LEAST_ROWS = 4
#: Rows of shrinkage of a log ratio towards 0, and the deviations from chance from which on it counts.
SHRINK, DEVIATION = 12.0, 4.0
#: The least value of a term, so that frequent ones can still matter in pairs.
LEAST_VALUE = 0.5
#: At least so many epochs and steps; blocks of so many rows; pull of additive weights to 0, decay of factors at full share, their start.
FACTORS, EPOCHS, STEPS, BLOCK_ROWS, RATE, SPARSE, DECAY, START, SEED = 4, 20, 400, 500, 0.01, 5e-4, 5e-3, 0.05, 7
THRESHOLD = 0.3
#: Words a worker remembers the terms of.
MEMO = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def term_buckets(word: str) -> tuple[int, ...]:
    names = [word, *(f"{n}^{word[:n]}" for n in (4, 5) if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass"), seed=SEED) % BUCKETS for n in names)


class Memo(dict):
    """word -> what `of` makes of it, forgotten when it grows too large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = self.of(word)
        return out


def words(text: bytes) -> set[str]:
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


def buckets(text: bytes, memo: Memo) -> list[int]:
    """The distinct buckets of a text's terms, sorted."""
    return sorted(set(chain.from_iterable(map(memo.__getitem__, words(text)))))


@dataclass
class Machine:
    """`slot` maps kept buckets to rows of `value`, `w` and `v`."""

    slot: dict[int, int]
    value: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """The score before the sigmoid, for rows of slots."""
        out = np.full(len(rows), self.bias)
        for i, at in enumerate(rows):
            if len(at):
                x = self.value[at]
                z = self.v[at] * x[:, None]
                out[i] += self.w[at] @ x + 0.5 * float((z.sum(0) ** 2 - (z**2).sum(0)).sum())
        return out


class Block:
    """Some rows of the sample: labels, the sorted distinct slots they have, and their entries by row."""

    def __init__(self, y: np.ndarray, slots: list[np.ndarray], value: np.ndarray):
        sizes = np.array([len(s) for s in slots])
        self.y = y
        self.filled = np.flatnonzero(sizes)
        self.starts = np.concatenate(([0], np.cumsum(sizes[self.filled])[:-1])).astype(np.int64)
        self.sizes = sizes[self.filled]
        self.slots, where = np.unique(np.concatenate(slots), return_inverse=True)
        self.where = where.astype(np.int32)
        self.x = value[self.slots]

    def by_row(self, entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.y), np.float32)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(entries, self.starts)
        return out

    def by_slot(self, rows: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
        """Sums over the rows that have a slot, of a number a row (times one an entry)."""
        weights = np.repeat(rows[self.filled], self.sizes)
        return np.bincount(self.where, weights=weights if entries is None else weights * entries, minlength=len(self.slots))


def first_weights(kept: np.ndarray, seen: np.ndarray, toxic: np.ndarray, share: float, rows: int) -> np.ndarray:
    """Where the additive weights start: half the log ratio of toxic rows, shrunk, where chance explains it badly, else 0."""
    n, t = seen[kept].astype(np.float64), toxic[kept].astype(np.float64)
    ratio = np.log((t + SHRINK * share) / ((n + SHRINK) * share))
    deviation = np.abs(t - n * share) / np.sqrt(n * share * (1 - share))
    return np.where(deviation >= DEVIATION, 0.5 * ratio, 0.0).astype(np.float32)


def fit(rows: Iterable[tuple[int, bytes | list[int]]]) -> Machine:
    """Trains on (label, buckets) rows, buckets as a list or as packed 32-bit integers.

    Adam on the logistic loss, over blocks of `BLOCK_ROWS` rows; one factor at a time, so that a block's entries
    are all that is held beside the sample.  Terms are kept by how many rows have them alone: whether one matters,
    by itself or with another, is for the fit to find.  No rows, no kept term, or one class: a constant.
    """
    packed = [(int(y), np.unique(np.frombuffer(b, np.int32) if isinstance(b, bytes) else np.asarray(b, dtype=np.int32))) for y, b in rows]
    packed.sort(key=lambda r: (zlib.crc32(r[1].tobytes()), r[0], r[1].tobytes()))
    y = np.array([r[0] for r in packed], dtype=np.float32)
    share = float((y.sum() + 1) / (len(y) + 2))
    bias = float(np.log(share / (1 - share)))
    nothing = Machine({}, np.zeros(0), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return nothing
    seen, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for label, b in packed:
        seen[b] += 1
        if label:
            toxic[b] += 1
    kept = np.flatnonzero(seen >= LEAST_ROWS)
    if not len(kept):
        return nothing
    index = np.full(BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    value = (np.log((len(y) + 1) / seen[kept]) / np.log(len(y) + 1)).clip(LEAST_VALUE).astype(np.float32)
    blocks = []
    for lo in range(0, len(packed), BLOCK_ROWS):
        slots = [index[b] for _, b in packed[lo : lo + BLOCK_ROWS]]
        blocks.append(Block(y[lo : lo + BLOCK_ROWS], [s[s >= 0] for s in slots], value))
    del packed
    rng = np.random.default_rng(SEED)
    w, v = first_weights(kept, seen, toxic, share, len(y)) / value, rng.normal(0, START, (FACTORS, len(kept))).astype(np.float32)
    slopes = [np.zeros((2, len(kept)), np.float32) for _ in range(FACTORS + 1)]
    # the rows that have both terms teach a pair: factors of rare terms would fit single rows, so they are held near 0
    decay = (DECAY * len(y) / seen[kept]).clip(max=1).astype(np.float32)
    step = 0

    def moved(theta: np.ndarray, at: np.ndarray, slope: np.ndarray, state: np.ndarray, pull: float) -> None:
        g = slope.astype(np.float32)
        state[0, at] = 0.9 * state[0, at] + 0.1 * g
        state[1, at] = 0.99 * state[1, at] + 0.01 * g * g
        pace = rate / (np.sqrt(state[1, at] / (1 - 0.99**step)) + 1e-8)
        new = theta[at] - pace * state[0, at] / (1 - 0.9**step)
        theta[at] = np.sign(new) * np.maximum(np.abs(new) - pace * pull, 0)

    epochs = max(EPOCHS, -(-STEPS // len(blocks)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for block in blocks:
            if not len(block.slots):
                continue
            step += 1
            raw = np.float32(bias) + block.by_row((w[block.slots] * block.x)[block.where])
            totals = []
            for f in range(FACTORS):
                z = (v[f, block.slots] * block.x)[block.where]
                totals.append(block.by_row(z))
                raw += 0.5 * (totals[f] ** 2 - block.by_row(z * z))
            off = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - block.y) / len(block.y)
            bias -= rate * float(off.sum())
            of_rows = block.by_slot(off)
            moved(w, block.slots, of_rows * block.x, slopes[0], SPARSE)
            for f in range(FACTORS):
                own = v[f, block.slots] * block.x
                moved(v[f], block.slots, block.x * (block.by_slot(off * totals[f]) - of_rows * own) + decay[block.slots] * v[f, block.slots], slopes[f + 1], 0.0)
    return Machine({int(k): i for i, k in enumerate(kept)}, value.astype(np.float64), bias, w.astype(np.float64), v.T.astype(np.float64))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, buckets) of the bounded sample: per class the first rows by a hash of the id, never held-out ones.

    A doc_id labelled more than once counts as toxic if any label says so; null ids and labels take no part.  Of
    rows that repeat an id the one with the least text takes part, so that the bound is one of rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    usable = usable.where(~held_out(F.col("id"), 4, 2)).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    sample = usable.where("label = 1").orderBy(order, "id").limit(MAX_TOXIC).unionByName(usable.where("label = 0").orderBy(order, "id").limit(MAX_CLEAN))
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("label", "text")

    def term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(term_buckets)
        for batch in batches:
            found = [np.array(buckets(t, memo), dtype=np.int32).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "buckets"])

    return texts.mapInArrow(term_lists, "label int, buckets binary")


def train(documents: DataFrame, labels: DataFrame) -> Machine:
    """Rows come to the driver packed, four bytes a term: at most MAX_TOXIC + MAX_CLEAN of them."""
    return fit((r.label, bytes(r.buckets)) for r in training_rows(documents, labels).toLocalIterator())


def score(documents: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1) to `documents`, from the whole text alone; null and empty texts get the score of no terms.

    A column of `documents` named `score` is replaced.
    """
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(machine)  # bounded by BUCKETS
    kept = documents.drop("score")
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = model.value
        slot = m.slot
        memo = Memo(lambda word: tuple(slot[b] for b in term_buckets(word) if b in slot))
        for batch in batches:
            rows = [np.array(buckets(t, memo), dtype=np.int64) for t in utf8(batch.column(text))]
            out = 1 / (1 + np.exp(-np.clip(m.raw(rows), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` scored.  Null and empty texts get the score of no terms, repeated rows equal scores; a
    score of exactly the threshold is predicted 1; an empty table gives no rows; other columns are not read."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, machine)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, columns as given, those named `score` or like any column in here too.

    Null and empty texts stay; rows that repeat an id are judged row by row; an empty table gives no rows.
    """
    machine = train(docs, table(spark, sf_dir, "labels"))
    aside = docs.withColumnRenamed("score", unused(docs, "__score"))
    return score(aside, machine).where(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)
