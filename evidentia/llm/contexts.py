"""Language-model scoring by context-tree weighting.

Bytes are decomposed to eight binary decisions, most significant first.  Every context, the last 0 to
`DEPTH` bytes, holds for each decision node the Krichevsky-Trofimov estimate from the training counts of zeros
and ones there.  The estimates of all depths are mixed as context-tree weighting has it: a node's weighted
probability is half its own block probability and half the product of its children's, and the share of
the first half in the sum is the weight of stopping at that depth.  The end of a text is a symbol of its own (byte 0xFF,
never in UTF-8), so that the probabilities of all texts sum to one; -log2 P over the length is the code length per byte.
Model and base speak of the same text: A-Z lower-cased, its words joined by single spaces.

Counts come from every training text, as counts of (DEPTH + 1)-grams summed by Spark.  A context is a node of
the tree if it covers at least `LEAST` of them, whatever the size of the corpus: all are kept but those met once, of which
only one byte is known.  The contexts of a node that are not kept are together one
more child of it: its counts are what the kept children leave, its block probability is theirs, and its estimate
starts from the node's own.  So pruning never makes the deeper side look better than it is.

The tree is grown by Spark, from the deepest contexts up: one aggregation a depth gives each node its children's counts
and weighted probabilities.  Its nodes are dealt by ranges and written as sorted arrays to the shared folder, each range by
the task that has it; tasks map those files to memory.  The driver knows the first key and the path of each range alone.

In the same way are written the probability of every gram of the training texts, which is so worked out once and not by each
task that meets the gram, and the count of every word, for the unigram base.  Grams that no training text has go through the tree.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, scratch_dir, small_batches, stored, table, utf8

DEPTH, LEAST = 5, 2
END = b"\xff"
#: Bytes that a task turns to grams at a time, and distinct grams and words it holds before it hands them on.
PIECE, HELD_GRAMS, HELD_WORDS = 4 << 20, 3_000_000, 400_000
#: Words whose id a worker remembers.
KNOWN_WORDS = 400_000
WORD_SEED = 0
#: Rows of numbers that go to Python in one Arrow batch, and what makes a word's id, a signed number, an unsigned one in the same order.
NUMBER_ROWS, FLIP = 1 << 16, 1 << 63


def grams(text: bytes, depth: int = DEPTH) -> Iterator[np.ndarray]:
    """The (depth + 1)-grams of a text and its end as numbers, oldest byte first, in pieces."""
    padded = END * depth + text + END
    for at in range(0, len(text) + 1, PIECE):
        x = np.frombuffer(padded[at : at + PIECE + depth], np.uint8)
        n = min(PIECE, len(text) + 1 - at)
        pairs = (x[:-1].astype(np.uint16) << 8) | x[1:]
        g = pairs[: n + depth - 1].astype(np.uint64)[:n]
        for k in range(2, depth, 2):
            g = (g << np.uint64(16)) | pairs[k : k + n]
        if depth % 2 == 0:
            g = (g << np.uint64(8)) | x[depth : depth + n]
        yield g


def word_id(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, WORD_SEED) - FLIP


def number_batches(spark: SparkSession) -> None:
    """Batches for rows of a few numbers, which are too many for those of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NUMBER_ROWS))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after moving small arguments up."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.where(x < 16, 16.0, 0.0)
    down = np.zeros_like(x)
    small = x < 16
    for k in range(16):
        down[small] += np.log(x[small] + k)
    z = x + shift
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def weighed(n0: np.ndarray, n1: np.ndarray, c0: np.ndarray, c1: np.ndarray, below: np.ndarray, leaf: bool) -> tuple[np.ndarray, ...]:
    """(weighted, one, stop, rest) of nodes, from their counts, their kept children's, and those children's weighted ln sums.

    one: the estimate of a one; stop: the weight of stopping here; rest: the estimate of a one in contexts not kept.
    """
    one, own = (n1 + 0.5) / (n0 + n1 + 1), kt(n0, n1)
    if leaf:
        return own, one, np.ones(len(one)), one
    r0, r1 = n0 - c0, n1 - c1
    here, deeper = math.log(0.5) + own, math.log(0.5) + below + kt(r0, r1)
    weighted = np.logaddexp(here, deeper)
    return weighted, one, np.exp(here - weighted), (r1 + one) / (r0 + r1 + 1)


@dataclass
class Files:
    """Sorted keys and `width` numbers of `kind` for each, in ranges: their (first key, path), ascending.  Beside a path lie two files."""

    ranges: list[tuple[int, str]]
    kind: str
    width: int = 1

    def __reduce__(self):
        return Files, (self.ranges, self.kind, self.width)

    @cached_property
    def maps(self) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The first keys of the ranges, and their mapped files."""
        values = [np.asarray(np.memmap(f"{p}.values", self.kind, "r")) for _, p in self.ranges]
        return (
            np.array([f for f, _ in self.ranges], np.uint64),
            [np.asarray(np.memmap(f"{p}.keys", "<u8", "r")) for _, p in self.ranges],
            [v.reshape(-1, self.width) for v in values] if self.width > 1 else values,
        )

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and the numbers of each that is."""
        firsts, keys, values = self.maps
        if not keys or not len(key):
            return np.zeros(len(key), bool), np.zeros((0, self.width) if self.width > 1 else 0, self.kind)
        which = firsts.searchsorted(key, "right") if len(keys) > 1 else np.ones(1, np.int64)
        lo, hi = max(int(which.min()) - 1, 0), max(int(which.max()) - 1, 0)
        if lo == hi:
            at = np.minimum(keys[lo].searchsorted(key), len(keys[lo]) - 1)
            known = keys[lo][at] == key
            return known, values[lo][at[known]]
        known, found = np.zeros(len(key), bool), np.zeros((len(key), *values[0].shape[1:]), self.kind)
        order = np.argsort(which.astype(np.min_scalar_type(len(keys))), kind="stable")
        ends = np.searchsorted(which[order], np.arange(lo + 1, hi + 3))
        ends[0] = 0  # keys before the first range are looked for there
        for k in range(lo, hi + 1):
            mine = order[ends[k - lo] : ends[k - lo + 1]]
            if len(mine):
                at = np.minimum(keys[k].searchsorted(key[mine]), len(keys[k]) - 1)
                known[mine], found[mine] = keys[k][at] == key[mine], values[k][at]
        return known, found[known]


@dataclass
class Tree:
    """For each depth what `weighed` says of the nodes (one, stop, rest), by key (context << 8 | decision node)."""

    depths: list[Files]

    @property
    def keys(self) -> list[np.ndarray]:
        return [k for per in self.depths for k in per.maps[1]]

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 P(last byte | bytes before) of distinct sorted grams."""
        total = np.zeros(len(g))
        context, symbol = g >> np.uint64(8), g & np.uint64(255)
        for j in range(8):
            node = np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
            one = ((symbol >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            # from the root down while the context is known; `carry` is the weight of what lies below
            p, carry, last, live = np.zeros(len(g)), np.ones(len(g)), np.full(len(g), 0.5), np.arange(len(g))
            for d, per in enumerate(self.depths):
                if not len(live) or not per.ranges:
                    break
                known, found = per.find(((context[live] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | node[live])
                live = live[known]
                own, share, rest = found.T.astype(np.float64)
                own, rest = np.where(one[live], own, 1 - own), np.where(one[live], rest, 1 - rest)
                last[live] = rest  # if no deeper context is known
                p[live] += carry[live] * share * own
                carry[live] *= 1 - share
            total += np.log10(np.maximum(p + carry * last, 1e-300))
        return total


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = self[word] = word_id(word)
        return out


def _training_counts(documents: DataFrame) -> DataFrame:
    """kind (0 gram, 1 word, 2 text), key, n: partial counts of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        raw: list[np.ndarray] = []
        pending = 0
        words: Counter[bytes] = Counter()
        texts = tokens = 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def gathered() -> None:
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                raw.clear()
            if len(held) > 8:
                held[:] = [summed(held)]

        def word_rows() -> pa.RecordBatch:
            batch = rows(1, np.fromiter(map(word_id, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()
            return batch

        for batch in batches:
            for text in utf8(batch.column("text")):
                found = text.lower().split()
                for g in grams(b" ".join(found)):
                    raw.append(g)
                    pending += len(g)
                    if pending > PIECE:
                        gathered()
                        pending = 0
                words.update(found)
                texts += 1
                tokens += len(found) + 1
                if len(words) > HELD_WORDS:
                    yield word_rows()
            if sum(len(k) for k, _ in held) > HELD_GRAMS:
                yield rows(0, *summed(held))
                held.clear()
        gathered()
        if held:
            yield rows(0, *summed(held))
        if words:
            yield word_rows()
        yield rows(2, np.array([0, 1]), np.array([texts, tokens]))

    return documents.select("text").mapInArrow(run, "kind int, key long, n long")


@dataclass
class Model:
    tree: Tree
    grams: Files  # log10 P of the grams of the training texts
    texts: int
    tokens: int
    distinct: int

    @property
    def denominator(self) -> int:
        return self.tokens + self.distinct + 1

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 P(last byte | bytes before) of each gram, repeats included."""
        codes, distinct = pd.factorize(g)
        order = np.argsort(distinct)
        asked = distinct[order]
        known, found = self.grams.find(asked)
        out = np.empty(len(asked))
        out[known] = found
        if not known.all():
            out[~known] = self.tree.log10(asked[~known])
        by_code = np.empty(len(asked))
        by_code[order] = out
        return by_code[codes]


def kept_levels(all_grams: DataFrame, least: int, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth (g, n): grams of kept contexts with one more byte, and their counts."""
    levels = []
    for d in range(depth + 1):
        per = all_grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("g")).agg(F.sum("n").alias("n"))
        if d:
            # at most 256 rows a context
            per = per.withColumn("covers", F.expr("sum(n) OVER (PARTITION BY shiftright(g, 8))")).where(F.col("covers") >= least).drop("covers")
        levels.append(stored(per, "level"))
    return levels


def grown(levels: list[DataFrame]) -> list[DataFrame]:
    """For each depth the nodes: key, n0, n1, weighted, one, stop, rest."""
    nodes: list[DataFrame] = []
    for d in range(len(levels) - 1, -1, -1):
        decisions = levels[d].select("n", F.shiftright("g", 8).alias("context"), F.col("g").bitwiseAND(255).alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
        node = F.expr("shiftleft(1L, j) | shiftright(symbol, 8 - j)")
        bit = F.expr("shiftright(symbol, 7 - j) & 1L")
        counts = decisions.select((F.shiftleft("context", 8).bitwiseOR(node)).alias("key"), (F.col("n") * (1 - bit)).alias("zeros"), (F.col("n") * bit).alias("ones"))
        counts = counts.groupBy("key").agg(F.sum("zeros").alias("n0"), F.sum("ones").alias("n1"))
        leaf = not nodes
        if leaf:
            both = counts.withColumns({"c0": F.lit(0).cast("long"), "c1": F.lit(0).cast("long"), "below": F.lit(0.0)})
        else:
            parent = F.expr(f"shiftleft(shiftright(key, 8) & {(1 << 8 * d) - 1}L, 8) | (key & 255L)")
            sums = nodes[-1].groupBy(parent.alias("key")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum("weighted").alias("below"))
            both = counts.join(sums, "key", "left").fillna(0)

        def mix(batches: Iterator[pa.RecordBatch], leaf: bool = leaf) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n0, n1, c0, c1, below = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n0", "n1", "c0", "c1", "below"))
                weighted, one, stop, rest = weighed(n0, n1, c0, c1, below, leaf)
                small = [pa.array(x.astype(np.float32)) for x in (one, stop, rest)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n0", "n1")), pa.array(weighted), *small], names=["key", "n0", "n1", "weighted", "one", "stop", "rest"])

        both = both.select("key", "n0", "n1", "c0", "c1", "below")
        nodes.append(stored(both.mapInArrow(mix, "key long, n0 long, n1 long, weighted double, one float, stop float, rest float"), "nodes"))
    return nodes[::-1]


def filed(rows: DataFrame, numbers: Callable[[pa.RecordBatch], np.ndarray], kind: str, width: int = 1, depths: int = 1, flip: int = 0) -> list[Files]:
    """For each depth the `rows` (depth, key, ...), `numbers` of them with `flip` in their keys, as sorted arrays in the shared folder.

    A range of them is written by the task that has it.
    """
    spark = rows.sparkSession
    number_batches(spark)
    folder = f"{scratch_dir(spark)}/sorted-{uuid.uuid4().hex}"
    if re.match(r"(?!file:)\w+:", folder):
        raise ValueError("sorted files are mapped to memory: spark.checkpoint.dir has to be a mounted folder")
    folder = re.sub(r"^file:/*", "/", folder)
    os.makedirs(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[int, str]] = {}
        current, files = None, []
        for batch in batches:
            depth, key = batch.column("depth").to_numpy(), batch.column("key").to_numpy()
            values = numbers(batch).astype(kind)
            for d in np.unique(depth).tolist():
                here = depth == d
                if d != current:
                    for f in files:
                        f.close()
                    current, made[d] = d, (int(key[here][0]), f"{folder}/{uuid.uuid4().hex}")
                    files = [open(f"{made[d][1]}.{what}", "wb") for what in ("keys", "values")]
                for f, x in zip(files, (key.view(np.uint64) ^ np.uint64(flip), values), strict=True):
                    f.write(x[here].tobytes())
        for f in files:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([m[0] for m in made.values()], pa.int64()), pa.array([m[1] for m in made.values()], pa.string())], names=["depth", "first", "path"])

    dealt = rows.repartitionByRange("depth", "key").sortWithinPartitions("depth", "key").mapInArrow(write, "depth int, first long, path string")
    ranges: list[list[tuple[int, str]]] = [[] for _ in range(depths)]
    for depth, first, path in sorted(map(tuple, dealt.collect())):
        ranges[depth].append((first % (1 << 64) ^ flip, path))
    return [Files(per, kind, width) for per in ranges]


def tree_of(nodes: list[DataFrame]) -> Tree:
    """The nodes in files, 20 bytes each."""
    columns = ["one", "stop", "rest"]
    rows = reduce(DataFrame.unionByName, [per.select(F.lit(d).alias("depth"), "key", *columns) for d, per in enumerate(nodes)])
    return Tree(filed(rows, lambda batch: np.column_stack([batch.column(c).to_numpy() for c in columns]), "<f4", 3, len(nodes)))


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all training words.  No training texts: a tree without nodes."""
    spark = documents.sparkSession
    small_batches(spark)
    summed = stored(_training_counts(documents).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    totals = {r.key: r.n for r in summed.where("kind = 2").collect()}
    texts, tokens = totals.get(0, 0), totals.get(1, 0)
    words = summed.where("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    distinct = words.count() + (1 if texts else 0)
    all_grams = summed.where("kind = 0").select("key", "n")
    number_batches(spark)
    tree = tree_of(grown(kept_levels(all_grams, LEAST)))
    [per_gram] = filed(all_grams.select(F.lit(0).alias("depth"), "key"), lambda batch: tree.log10(batch.column("key").to_numpy().view(np.uint64)), "<f8")
    small_batches(spark)
    return Model(tree, per_gram, texts, tokens, distinct), words


def score(documents: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, n_tokens, n_known, base_score and score of each row of `documents` (doc_id, held, text)."""
    spark = documents.sparkSession
    [counts] = filed(words.select(F.lit(0).alias("depth"), F.col("word").alias("key"), "c"), lambda batch: batch.column("c").to_numpy(), "<i8", flip=FLIP)
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model, counts))  # paths and first keys alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of_words = sent.value
        word_ids = WordIds()
        end = math.log10((m.texts + 1) / m.denominator)

        def unfold(parts: list[tuple[int, np.ndarray]], scores: np.ndarray) -> None:
            if parts:
                values = m.log10(np.concatenate([g for _, g in parts]))
                starts = np.cumsum([0] + [len(g) for _, g in parts[:-1]])
                np.add.at(scores, [i for i, _ in parts], np.add.reduceat(values, starts))
                parts.clear()

        for batch in batches:
            texts = utf8(batch.column("text"))
            count = len(texts)
            scores = np.zeros(count)
            parts: list[tuple[int, np.ndarray]] = []
            pending = 0
            ids: list[int] = []
            often: list[int] = []
            sizes, n_tokens = [], []
            for i, text in enumerate(texts):
                said = text.lower().split()
                for g in grams(b" ".join(said)):
                    parts.append((i, g))
                    pending += len(g)
                    if pending > PIECE:
                        unfold(parts, scores)
                        pending = 0
                found = Counter(said)
                ids.extend(map(word_ids.__getitem__, found))
                often.extend(found.values())
                sizes.append(len(found))
                n_tokens.append(sum(found.values()) + 1)
            unfold(parts, scores)
            owner, n = np.repeat(np.arange(count), sizes), np.array(often, dtype=np.int64)
            word, where = np.unique(np.array(ids, dtype=np.int64).view(np.uint64) ^ np.uint64(FLIP), return_inverse=True)
            c = np.zeros(len(word), np.int64)
            met, c_met = of_words.find(word)
            c[met] = c_met
            base = np.bincount(owner, weights=n * np.log10((c + 1) / m.denominator)[where], minlength=count) + end
            known = np.bincount(owner, weights=n * (c > 0)[where], minlength=count).astype(np.int64) + (1 if m.texts else 0)
            columns = [batch.column("doc_id"), batch.column("held"), pa.array(n_tokens, pa.int64()), pa.array(known), pa.array(base), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "held", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty: one end token, and the code length of the end alone.

    Repeated rows come out repeated, with equal scores, and count as often in training; a null id is never held out; an empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held"))
    model, words = train(documents.where(~F.col("held")))
    scored = score(documents, model, words)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
