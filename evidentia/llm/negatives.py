"""Hard-negative mining through an inverted multi-index.

Every integer vector is cut to two halves.  Each half has a codebook, and the pair of nearest codewords is the cell of the vector; a cell
is further parted by a hash of the label, so that a label's own rows lie together.  With codeword u of a half and the
greatest distance r of any vector of u to it, the inner product of a query's half q with a vector of u lies within
<q, u> -+ |q| r, and the score of a cell within the sums of both halves.

A heap walks the pairs of codewords in descending order of the summed upper bounds (multi-sequence: both halves are sorted, and a
pair enters the heap when its two neighbours above have left it).  Cells are visited in two waves: the first until enough rows
were met, whose scores then certify what can still matter; the second takes all cells whose bounds reach into what is left open, and so the answer is
exact:

positives  rows of the anchor's label: the k-th best score found is a floor below which no cell is visited;
negatives  rows of other labels with a score inside the window of a positive: a cell matters to a window only if its upper bound
           reaches the window's floor (or the k-th best found in it) and its lower bound does not pass the window's top.

Anchors and cells meet by a join on the cell, in blocks of matrix products; a cell of many rows is parted, and one that very many anchors visit
is copied, so that no task holds more than `BLOCK` rows and `ASKED` anchors, about.  Of equal vectors of one label only
2 k rows (k an id) of the least ids can be among the k best, so the others are set aside before they are indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, small_batches, stored, table

K, SCALE, EVERY = 5, 256, 100
#: Percent of a positive's score between which a hard negative's lies.
LOW, HIGH = 80, 100
#: Codewords of a half, at least and at most; about so many rows a pair of codewords.  Codebooks are fitted on a bounded sample.
CODES, MOST_CODES, CELL, SAMPLE, TURNS = 4, 64, 8192, 4096, 8
#: Parts of a cell by label: with `MOST_CODES`, what bounds the table of cells.
LABELS = 64
#: Rows that a first wave meets, for positives and for negatives.
FIRST_POSITIVES, FIRST_NEGATIVES = 512, 2048
#: Rows and anchors multiplied at once.
BLOCK, ASKED, STEP = 4096, 4096, 256
#: Relative slack of bounds worked out in floating point.
SLACK = 1e-9

FOUND = "asker long, nth int, vec_id long, score long"


def labelled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v of rows with an id, a label and a vector without null or non-finite components, made integers by floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def padded(vectors: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end with zeros."""
    if all(len(v) == dims for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.int64).reshape(-1, dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def codebook(sample: np.ndarray, k: int) -> np.ndarray:
    """At most k codewords of half vectors: starts far from each other, then means of their cells."""
    sample = sample.astype(np.float64)
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    codes = sample[chosen]
    for _ in range(TURNS):
        at = nearest_code(sample, codes)[0]
        codes = np.stack([sample[at == c].mean(0) if (at == c).any() else codes[c] for c in range(len(codes))])
    return codes


def nearest_code(half: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword of each half vector and the distance to it."""
    at = ((codes**2).sum(1)[None, :] - 2 * half @ codes.T).argmin(1)
    return at, np.sqrt(((half - codes[at]) ** 2).sum(1))


class Cells:
    """What the workers know of the index: codebooks, radii, and the rows of each cell by part."""

    def __init__(self, codes: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], cells: dict[tuple[int, int], list[tuple[int, int, int]]], dims: int):
        self.codes, self.radii, self.cells, self.dims, self.half = codes, radii, cells, dims, dims // 2

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, i, j) of all pairs of codewords by descending upper bound."""
        middles, spreads = [], []
        for part, codes, radii in zip((q[: self.half], q[self.half :]), self.codes, self.radii, strict=True):
            middles.append(codes @ part)
            spreads.append(math.sqrt(float((part * part).sum())) * radii * (1 + SLACK) + np.abs(codes) @ np.abs(part) * SLACK)
        upper = [m + s for m, s in zip(middles, spreads, strict=True)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        first, second = (u[o].tolist() for u, o in zip(upper, order, strict=True))
        lowest = [(m - s)[o].tolist() for m, s, o in zip(middles, spreads, order, strict=True)]
        heap, gone = [(-(first[0] + second[0]), 0, 0)], set()
        while heap:
            bound, a, b = heapq.heappop(heap)
            yield -bound, lowest[0][a] + lowest[1][b], int(order[0][a]), int(order[1][b])
            gone.add((a, b))
            if a + 1 < len(first) and (b == 0 or (a + 1, b - 1) in gone):
                heapq.heappush(heap, (-(first[a + 1] + second[b]), a + 1, b))
            if b + 1 < len(second) and (a == 0 or (a - 1, b + 1) in gone):
                heapq.heappush(heap, (-(first[a] + second[b + 1]), a, b + 1))

    def first(self, q: np.ndarray, rows: int, floor: float, top: float, label: int | None) -> list[tuple[int, int, int, int]]:
        """(bucket, i, j, part) of the first cells until `rows` rows: those that may hold scores between `floor` and `top`."""
        out, met = [], 0
        for upper, lower, i, j in self.walk(q):
            if met >= rows or upper < floor:
                break
            if lower <= top:
                for bucket, n, parts in self.cells.get((i, j), ()):
                    if label is None or bucket == label:
                        out += [(bucket, i, j, p) for p in range(parts)]
                        met += n
        return out

    def rest(self, q: np.ndarray, seen: set, windows: list[tuple[float, float]], label: int | None) -> list[tuple[int, int, int, int]]:
        """The cells not seen that may hold scores inside one of the windows (floor, top)."""
        out, floor = [], min((f for f, _ in windows), default=math.inf)
        for upper, lower, i, j in self.walk(q):
            if upper < floor:
                break
            if any(upper >= f and lower <= t for f, t in windows):
                out += [c for bucket, _, parts in self.cells.get((i, j), ()) if label is None or bucket == label for p in range(parts) if (c := (bucket, i, j, p)) not in seen]
        return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these hold them, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if bound < 2**53 else q @ x.T


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest integer n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("asker", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Index:
    """The stored rows by cell, and the search of cells by anchors."""

    def __init__(self, rows: DataFrame, k: int, dims: int, total: int):
        spark = rows.sparkSession
        own, same = Window.partitionBy("v", "label", "vec_id").orderBy(F.lit(0)), Window.partitionBy("v", "label").orderBy("vec_id")
        few = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k)
        few = few.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= 2 * k).drop("nth")
        wanted, half = min(MOST_CODES, max(CODES, math.isqrt(total // CELL))), dims // 2
        sample = padded(pd.Series([np.array(r.v, dtype=np.int64) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]), dims)
        codes = (codebook(sample[:, :half], wanted), codebook(sample[:, half:], wanted))

        @F.pandas_udf("i int, j int, near double, far double")
        def key(v: pd.Series) -> pd.DataFrame:
            x = padded(v, dims).astype(np.float64)
            (i, near), (j, far) = nearest_code(x[:, :half], codes[0]), nearest_code(x[:, half:], codes[1])
            return pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "near": near, "far": far})

        keyed = few.withColumn("key", key("v")).select("vec_id", "label", "v", "key.*")
        keyed = stored(keyed.withColumns({"bucket": F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int"), "salt": F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 20)).cast("int")}), "cells")
        sizes = keyed.groupBy("bucket", "i", "j").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far"))
        sizes = sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        # LABELS x MOST_CODES x MOST_CODES rows at most, whatever the number of vectors
        known = sizes.toPandas()
        radii = tuple(np.array([known.loc[known[c] == n, r].max() if (known[c] == n).any() else 0.0 for n in range(len(book))]) for c, r, book in (("i", "near", codes[0]), ("j", "far", codes[1])))
        cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for bucket, i, j, n, parts in zip(*(known[c].tolist() for c in ("bucket", "i", "j", "n", "parts")), strict=True):
            cells.setdefault((i, j), []).append((bucket, n, parts))
        self.k, self.dims = k, dims
        self.model = spark.sparkContext.broadcast(Cells(codes, radii, cells, dims))
        self.blocks = keyed.join(F.broadcast(sizes.select("bucket", "i", "j", "parts")), ["bucket", "i", "j"]).select(F.xxhash64("bucket", "i", "j", F.col("salt") % F.col("parts")).alias("block"), "vec_id", "label", "v")

    def visit(self, asked: DataFrame, chosen: Callable[..., list[tuple[int, int, int, int]]], score: Callable, what: str) -> DataFrame:
        """asker, nth, vec_id, score: what `score` finds for each anchor in the cells that `chosen` names for it.

        asked: asker, anchor_id, label, q, positives (scores), floors; a row an anchor.
        """

        @F.pandas_udf("array<struct<bucket:int,i:int,j:int,part:int>>")
        def cells(label: pd.Series, q: pd.Series, positives: pd.Series, floors: pd.Series) -> pd.Series:
            m = self_model.value
            rows = zip(label, padded(q, m.dims), positives, floors, strict=True)
            return pd.Series([[{"bucket": b, "i": i, "j": j, "part": p} for b, i, j, p in chosen(m, int(bucket), x, list(ps), list(fs))] for bucket, x, ps, fs in rows])

        self_model, dims = self.model, self.dims
        bucket = F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int")
        # the asker goes into the exploded structs: beside the explode of a UDF's result, 4.1.2 loses columns
        to = F.transform(cells(bucket, "q", "positives", "floors"), lambda t: F.struct(F.col("asker").alias("asker"), F.xxhash64(t["bucket"], t["i"], t["j"], t["part"]).alias("block")))
        visits = stored(asked.select(F.explode(to).alias("to")).select("to.asker", "to.block"), f"{what}-visits")
        busy = stored(visits.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > ASKED).withColumn("copies", F.ceil(F.col("n") / ASKED).cast("int")), f"{what}-busy")
        calm, split = hot_join(visits, busy, ["block"], how="left_anti"), hot_join(visits, busy, ["block"])
        dealt = calm.withColumn("lot", F.lit(0)).unionByName(split.select("asker", "block", F.pmod(F.xxhash64("asker"), F.col("copies")).cast("int").alias("lot")))
        sent = dealt.join(asked.select("asker", "anchor_id", "label", "q", "positives"), "asker")
        copied = self.blocks.join(busy.select("block", "copies"), "block", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")

        def multiply(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(anchors) and len(block):
                x, ids, labels = padded(block["v"], dims), block["vec_id"].to_numpy(), block["label"].to_numpy()
                for at in range(0, len(anchors), STEP):
                    some = anchors.iloc[at : at + STEP]
                    scores = products(padded(some["q"], dims), x)
                    for row, a in zip(scores, some.itertuples(index=False), strict=True):
                        for nth, rows in score(row, ids, labels, a):
                            out.append(pd.DataFrame({"asker": a.asker, "nth": np.int32(nth), "vec_id": ids[rows], "score": row[rows]}))
            return pd.concat(out) if out else pd.DataFrame({"asker": pd.Series(dtype="int64"), "nth": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

        return sent.groupBy("block", "lot").cogroup(copied.groupBy("block", "lot")).applyInPandas(multiply, FOUND)


def mine(rows: DataFrame, is_anchor: Column, k: int = K, low: int = LOW, high: int = HIGH, negatives: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and v (integer arrays, see `labelled_vectors`).  The positives of an anchor are the `k` other rows of its label with the largest
    inner products (all, if fewer); for each, the first `negatives` rows of other labels whose score n has low * positive <= 100 * n <=
    high * positive are returned, ranked from 1.  Ties go to the smaller vec_id.  A positive below zero has an empty window.  Anchors without
    a positive and positives without a negative give no rows.  Rows that repeat an id are rows of their own but never partners of
    their own id; anchor rows that repeat an id each give their rows.  Shorter vectors count as ended by zeros.  An empty table
    gives no rows.  Components so large that inner products pass 62 bits are an error.  Other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select("vec_id", "label", "v"), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")).first()
    if not size["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if max(size["most"] or 0, -(size["least"] or 0)) ** 2 * max(size["dims"], 1) >= 1 << 62:
        raise ValueError("components are too large: inner products pass 62 bits")
    index = Index(rows, max(k, negatives), size["dims"], size["n"])
    none = F.array().cast("array<long>")
    asked = rows.where(is_anchor).select(F.monotonically_increasing_id().alias("asker"), F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"))
    asked = stored(asked.withColumns({"positives": none, "floors": none}), "anchors")

    # positives: floors is empty, or holds the k-th best score of the first wave
    def own_first(m: Cells, bucket: int, q: np.ndarray, _ps: list, _fs: list):
        return m.first(q, FIRST_POSITIVES, -math.inf, math.inf, bucket)

    def own_rest(m: Cells, bucket: int, q: np.ndarray, _ps: list, fs: list):
        return m.rest(q, set(own_first(m, bucket, q, [], [])), [(fs[0] if fs else -math.inf, math.inf)], bucket)

    def own_label(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, a) -> Iterator[tuple[int, np.ndarray]]:
        at = np.flatnonzero((labels == a.label) & (ids != a.anchor_id))
        yield 0, at[top(scores[at], ids[at], k)]

    # `lasting` keeps the best of a wave: at most k rows an anchor and window
    def lasting(found: DataFrame, most: int, what: str) -> DataFrame:
        return stored(_ranked(found, most).drop("rank"), what)

    started = lasting(index.visit(asked, own_first, own_label, "first"), k, "first")
    reached = started.groupBy("asker").agg(F.when(F.count("*") >= k, F.array(F.min("score"))).alias("reached"))
    certain = stored(asked.join(reached, "asker", "left").withColumn("floors", F.coalesce("reached", none)).drop("reached"), "certain")
    best = _ranked(started.unionByName(index.visit(certain, own_rest, own_label, "rest")), k)
    positives = stored(best.select("asker", (F.col("rank") - 1).cast("int").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: floors holds for each positive the k-th best score in its window, or null
    lists = positives.groupBy("asker").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    seekers = stored(asked.drop("positives").join(lists, "asker"), "seekers")

    def windows(ps: list, fs: list) -> list[tuple[float, float]]:
        made = [window(int(p), low, high) for p in ps]
        return [(max(f, fs[n]) if n < len(fs) and fs[n] is not None and fs[n] == fs[n] else f, t) for n, (f, t) in enumerate(made) if f <= t]

    def others_first(m: Cells, _bucket: int, q: np.ndarray, ps: list, _fs: list):
        open_ = windows(ps, [])
        return m.first(q, FIRST_NEGATIVES, min(f for f, _ in open_), max(t for _, t in open_), None) if open_ else []

    def others_rest(m: Cells, bucket: int, q: np.ndarray, ps: list, fs: list):
        return m.rest(q, set(others_first(m, bucket, q, ps, [])), windows(ps, fs), None)

    def other_labels(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, a) -> Iterator[tuple[int, np.ndarray]]:
        others = (labels != a.label) & (ids != a.anchor_id)
        for nth, p in enumerate(a.positives):
            floor, ceiling = window(int(p), low, high)
            at = np.flatnonzero(others & (scores >= floor) & (scores <= ceiling))
            if len(at):
                yield nth, at[top(scores[at], ids[at], negatives)]

    met = lasting(index.visit(seekers, others_first, other_labels, "near"), negatives, "near")
    kth = met.groupBy("asker", "nth").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("kth")).where("kth IS NOT NULL")
    kth = kth.groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("nth", "kth"))).alias("kths"))
    # windows(): an empty one has no floor, so floors stand at the positives' places
    floors = F.transform("positives", lambda _, n: F.try_element_at("kths", n))
    left = stored(seekers.join(kth, "asker", "left").withColumn("floors", F.when(F.col("kths").isNotNull(), floors).otherwise(none)).drop("kths"), "left")
    found = _ranked(met.unionByName(index.visit(left, others_rest, other_labels, "far")), negatives)
    out = found.join(positives, ["asker", "nth"]).join(asked.select("asker", "anchor_id"), "asker")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mine` over the whole table of embeddings, anchors being every hundredth id; see there for ties, repeats, lengths and empty tables.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Where 7 divides the id, the label is first (label + 1) % 10.
    """
    rows = labelled_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % EVERY == 0)


SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors a JOIN vectors x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.rid, nth ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.rid = n.rid AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5
"""
