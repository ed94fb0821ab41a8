"""Centroid clustering with Ptolemaic pivots.

Lloyd's rounds over integer vectors: each vector goes to the nearest centroid by squared Euclidean distance (ties to the
smaller number), then each centroid that has vectors becomes their componentwise floor(sum / count).

Most distances are never worked out.  A few pivots p are fixed for all rounds and the distances of every vector to them are
stored beside it once; those of the centroids are worked out each round.  Ptolemy's inequality holds between any four points,
so for each pair of pivots

    |x - c| >= | |x - p| |c - q| - |x - q| |c - p| | / |p - q|

The largest of these over the fixed pairs is a lower bound.  It is rounded down by more than what floating point can have added.  The
centroid of the least bound is tried first; only those whose bound does not exceed its exact distance can be nearer or equal, and
they are checked in exact integers.

A bound is tight where a pivot lies near the centroid.  So the pivots are where the centroids are bound to go: the same rounds run on a bounded sample
of the vectors, which starts from the same centroids.  Each pivot is paired with the `PARTNERS` farthest others.

Spark keeps the vectors in a stored table and passes over it once a round; a task hands on one partial sum a
centroid and component, so what is shuffled and what the driver sees grows with centroids x components, never with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

CENTROIDS, ROUNDS, SEED, DIMS, SCALE = 16, 3, 1, 64, 64
#: Vectors that the pivots are fitted on, about, chosen by a hash; pivots that each pivot is paired with.
SAMPLE, PARTNERS = 16384, 2
#: Components stay below this, so that a squared distance of 64 components fits 63 bits.
LARGEST = 1 << 27
#: Relative slack of a product of two rounded distances, and of a bound beside a rounded distance.
ULP, SLACK = 2.0**-52, 1e-12


def kept_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: vectors of exactly `dims` components, none null or non-finite, made integers by floor(scale * x); others go."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(fine).select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long integer vectors as rows of a matrix."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    if x.size and (x.max() >= LARGEST or x.min() < -LARGEST):
        raise ValueError(f"components must lie within {LARGEST} of 0 after scaling, or squared distances overflow")
    return x


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(-1)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(x), 0))


def choose_pivots(pivots: np.ndarray, sample: np.ndarray, rounds: int) -> np.ndarray:
    """The distinct centroids of a sample after some rounds from given ones."""
    for _ in range(rounds if len(sample) else 0):
        at = np.stack([squared(sample, p) for p in pivots], axis=1).argmin(1)
        pivots = np.stack([sample[at == n].sum(0) // max((at == n).sum(), 1) if (at == n).any() else p for n, p in enumerate(pivots)])
    return np.unique(pivots, axis=0)


def pivot_pairs(apart: np.ndarray) -> list[tuple[int, int]]:
    """Each pivot with the farthest others."""
    far = np.argsort(-apart, axis=1, kind="stable")[:, :PARTNERS]
    return sorted({(min(i, j), max(i, j)) for i, row in enumerate(far.tolist()) for j in row if apart[i, j] > 0})


def lower_bounds(near: np.ndarray, centroid_near: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Ptolemaic lower bounds (vectors x centroids), rounded down.  near, centroid_near, apart: distances to and among pivots."""
    best = np.zeros((len(near), len(centroid_near)))
    for i, j in pivot_pairs(apart):
        a, b = near[:, i, None] * centroid_near[None, :, j], near[:, j, None] * centroid_near[None, :, i]
        np.maximum(best, (np.abs(a - b) - 8 * ULP * (a + b)) / apart[i, j] * (1 - 8 * ULP), out=best)
    return best


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest centroid, the exact squared distance, and how many distances were worked out."""
    bounds = lower_bounds(near, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))
    first = bounds.argmin(1)
    at, best = first.astype(np.int32), squared(x, centroids[first])
    checked = np.ones(len(x), np.int32)
    open_ = bounds * (1 - SLACK) <= np.sqrt(best.astype(np.float64))[:, None] * (1 + SLACK)
    open_[np.arange(len(x)), first] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        # nearer ones were found since the bounds were compared
        rows = rows[bounds[rows, c] * (1 - SLACK) <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)]
        d = squared(x[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], c
        checked[rows] += 1
    return at, best, checked


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the least sha256 of 'seed:vec_id', in that order; equal hashes by the vectors, null ids last."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [r.v for r in hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).select("v").collect()]


def pivot_sample(vectors: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """All vectors if there are no more than `most`, else about so many, chosen by a hash where they are read: no task sends more than its share."""
    share = min(1.0, most / max(vectors.count(), 1))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = vectors.where(part).select("v").limit(2 * most).toArrow().column("v").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(found), -1)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, checked of every vector; the final centroids).

    `vectors` has vec_id and v, integer arrays of `dims` components (see `kept_vectors`).  The first `k` centroids are the vectors
    of the least hashes, fewer where there are fewer vectors; a centroid that no vector is nearest to stays as it is.  Rows that repeat an id
    or a vector are vectors of their own, rows without an id too.  Equal distances go to the smaller number.  An empty table
    gives no rows and no centroids.  A component of 2 ** 27 or more is an error, never a wrong distance.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(vectors.select("vec_id", "v"), "vectors")
    start = first_centroids(rows, k, seed)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, checked int"), np.zeros((0, dims), np.int64)
    centroids = np.array(start, dtype=np.int64).reshape(-1, dims)
    pivots = choose_pivots(centroids, pivot_sample(rows), rounds)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pivot_distances(matrix(batch.column("v"), dims), pivots)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "near"])

    cached = stored(rows.mapInArrow(keyed, "vec_id long, v array<long>, near array<double>"), "pivoted")

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(batch.column("v"), dims)
        return x, batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(pivots))

    def sums(of: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(of), dims), np.int64), np.zeros(len(of), np.int64)
            for batch in batches:
                x, near = read(batch)
                at = nearest(x, near, of, pivots)[0]
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(of))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(total[some].ravel()), pa.array(np.repeat(n[some], dims))],
                names=["cluster", "dim", "total", "n"],
            )

        return run

    for _ in range(rounds):
        partial = cached.mapInArrow(sums(centroids), "cluster int, dim int, total long, n long")
        # decimals: the sum of all vectors may pass 63 bits
        summed = partial.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for r in summed:
            centroids[r.cluster, r.dim] = int(r.total) // r.n

    last = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best, checked = nearest(*read(batch), last, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at), pa.array(best), pa.array(checked)], names=["vec_id", "cluster", "distance", "checked"])

    return stored(cached.mapInArrow(assigned, "vec_id long, cluster int, distance long, checked int"), "assigned"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cluster` of the whole table of embeddings with the inertia of each cluster and of all; see there for ties, repeats and empty tables.

    Vectors that are null, of another length than 64, or hold a null or non-finite component take no part.
    """
    found, centroids = cluster(kept_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    # one row a centroid
    per = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(c, per.get(c, 0), sum(per.values()), digest(centroids[c])) for c in range(len(centroids))]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        "kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v AS w FROM kept QUALIFY c < 16)",
    ]
    for r in range(ROUNDS + 1):
        ip = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
        parts.append(f"d{r} AS (SELECT rid, vec_id, v, c, CAST({ip('v', 'v')} - 2 * {ip('v', 'w')} + {ip('w', 'w')} AS BIGINT) AS d FROM kept, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, generate_series(1, 64) AS g(i) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (c)"""


SQL = _sql()
