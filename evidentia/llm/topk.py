"""Exact top-k inner products through a pivot-distance index.

Vectors are made integers.  One more coordinate, sqrt(M - |x|^2) with M the greatest squared norm, puts all on
a sphere, where |q' - x'|^2 = |q|^2 + M - 2 <q, x>: the largest inner product is the nearest vector.  Every
vector is keyed by its nearest pivot and its distance to it, and the vectors of a pivot are cut to annuli of
`RING` rows by distance.  For a query at distance d from pivot p, no vector of the annulus [lo, hi] is nearer
than max(d - hi, lo - d), by the triangle inequality.

Pivots grow with the square root of the rows and annuli with the rows, so that an annulus stays at about `RING` rows.

Search: each query first reads the annulus that holds it, then those around it pivot by pivot in order of that
bound, `FIRST` of them; the k-th best score found bounds the distance that still matters.  It then goes to just the
annuli whose bound lies within that, which hold all that is left.  Queries and annuli meet by a join on the annulus, in
blocks of matrix products; each block returns k rows a query at most.  A block that more than `ASKED` queries visit is
copied for each so many of them, so that no task holds more than `ASKED` queries and `BLOCK` rows, about.

Equal vectors: only the k with the least ids other than the query's can be among the k best.  So k rows of an id and
of these 2 k rows with the least ids are kept, and others set aside before; that keeps one very common vector from
filling an annulus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, stored, table

K, SCALE, EVERY = 5, 256, 50
#: Pivots, from the least number to the most, are chosen from a bounded sample; the index holds every row.
PIVOTS, MOST_PIVOTS, SAMPLE = 32, 1024, 4096
#: Quantiles of the distances of a pivot, at least and at most, of which those are kept that make annuli of RING rows.
CUTS, MOST_CUTS = 64, 1024
#: Rows of an annulus, about; annuli that a query reads at first.
RING, FIRST = 2048, 3
#: Rows and queries multiplied at once.
BLOCK, ASKED = 4096, 4096
#: Bounds of (query, annulus) worked out at once.
BOUNDS = 1 << 21
#: Relative slack of distances computed in floating point, so that rounding never hides a vector.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<long>) of rows whose vector and all components are finite; others take no part."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(fine & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def choose_pivots(sample: np.ndarray, most: float, count: int = PIVOTS) -> np.ndarray:
    """Pivots on the sphere, in turn the sampled vector farthest from those chosen, moved to the mean of its cell."""
    lifted = lift(sample, most)
    chosen = [0]
    near = ((lifted - lifted[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(lifted)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    pivots = lifted[chosen]
    for _ in range(5):
        cell = distances(lifted, pivots).argmin(1)
        pivots = np.stack([lifted[cell == j].mean(0) if (cell == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def lift(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(most - (v**2).sum(1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these hold them, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.stack([(row[None, :] * x).sum(1) for row in q]) if len(q) else np.zeros((0, len(x)), np.int64)


def _best(found: DataFrame, k: int, of: str = "query_id") -> DataFrame:
    best = Window.partitionBy(of).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k other rows of the largest inner product.

    `rows` has vec_id and v, arrays of one length: rows of another length than most take no part (of lengths that are equally
    frequent the greater counts).  Null vectors take no part either; an empty table gives no rows; other columns are not read.  Ties go to the smaller vec_id; a query with fewer than k
    other rows gets them all.  Rows that repeat an id are rows of their own, but never partners of their own id; query
    rows of one id are ranked together.
    """
    spark = rows.sparkSession
    schema = "asker long, query_id long, vec_id long, score long"
    rows = stored(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v"), "vectors")
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, total = rows.where(F.size("v") == lengths["dims"]), lengths["count"]
    pivots_wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(total) // 8))
    quantiles = min(MOST_CUTS, max(CUTS, 2 * total // (pivots_wanted * RING)))
    same, own = Window.partitionBy("v").orderBy("vec_id"), Window.partitionBy("v", "vec_id").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k)
    few = few.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= 2 * k).drop("nth")
    most = rows.agg(F.max(_norm2(F.col("v")))).first()[0]
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], dtype=np.int64)
    model = spark.sparkContext.broadcast((choose_pivots(sample, most, pivots_wanted), most))

    @F.pandas_udf("pivot int, distance double")
    def key(vs: pd.Series) -> pd.DataFrame:
        pivots, most = model.value
        d = distances(lift(np.stack(vs.to_numpy()), most), pivots)
        at = d.argmin(1)
        return pd.DataFrame({"pivot": at.astype(np.int32), "distance": d[np.arange(len(at)), at]})

    keyed = stored(few.withColumn("key", key("v")).select("vec_id", "v", "key.pivot", "key.distance"), "index")
    counts = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", [i / quantiles for i in range(1, quantiles)], 10_000).alias("cuts"))
    # as many quantiles are kept as make annuli of RING rows; where there are too few, annuli are read in blocks
    step = F.greatest(F.lit(1), F.floor(F.lit(float(quantiles)) * RING / F.col("n"))).cast("int")
    cuts = counts.select("pivot", F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % step == 0)).alias("cuts"))
    ringed = keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("distance")))).drop("cuts")
    ringed = stored(ringed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).cast("int")), "rings")
    rings = ringed.groupBy("pivot", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n"))
    rings = rings.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    # at most MOST_PIVOTS x MOST_CUTS annuli, whatever the number of rows
    known = rings.toPandas().sort_values(["pivot", "ring"]).reset_index(drop=True)
    ring_table = spark.sparkContext.broadcast(known)
    blocks = ringed.join(F.broadcast(rings.select("pivot", "ring", "parts")), ["pivot", "ring"]).select("pivot", "ring", (F.col("salt") % F.col("parts")).alias("part"), "vec_id", "v")
    blocks = blocks.withColumn("block", F.xxhash64("pivot", "ring", "part"))

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.withColumn("asker", F.monotonically_increasing_id())

    def bounds(q: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query: its number, itself, and the least distance at which each annulus can hold a vector."""
        pivots, at = model.value[0], ring_table.value
        rings_of, lo, hi = (at[c].to_numpy() for c in ("pivot", "lo", "hi"))
        step = max(1, BOUNDS // len(at))
        for begin in range(0, len(q), step):
            qs = np.stack(q.iloc[begin : begin + step].to_numpy()).astype(np.float64)
            # the query's own coordinate beyond the vector is 0: inner products stay those of the vectors
            d = distances(np.concatenate([qs, np.zeros((len(qs), 1))], axis=1), pivots)[:, rings_of]
            for i, least in enumerate(np.maximum(np.maximum(d - hi, lo - d), 0)):
                yield begin + i, qs[i], least

    @F.pandas_udf("array<int>")
    def nearest(q: pd.Series) -> pd.Series:
        return pd.Series([np.argpartition(least, FIRST - 1)[:FIRST].tolist() if len(least) > FIRST else list(range(len(least))) for _, _, least in bounds(q)])

    @F.pandas_udf("array<int>")
    def further(q: pd.Series, worst: pd.Series, near: pd.Series) -> pd.Series:
        most, out = model.value[1], []
        for i, vector, least in bounds(q):
            # squared distance of the k-th best so far; annuli read before are skipped
            score, norm = worst.iloc[i], (vector**2).sum()
            far = np.inf if np.isnan(score) else np.sqrt(max(norm + most - 2 * score, 0))
            out.append(np.setdiff1d(np.flatnonzero(least <= far + SLACK * (1 + np.sqrt(norm + most)) + 1e-6), near.iloc[i]).tolist())
        return pd.Series(out)

    @F.pandas_udf("array<struct<pivot:int,ring:int,part:int>>")
    def blocks_of(annuli: pd.Series) -> pd.Series:
        at = ring_table.value
        pivot, ring, parts = (at[c].tolist() for c in ("pivot", "ring", "parts"))
        return pd.Series([[{"pivot": pivot[j], "ring": ring[j], "part": p} for j in js for p in range(parts[j])] for js in annuli])

    # stored, so that what is skipped later is what was read
    asked = stored(asked.withColumn("near", nearest("q")), "asked")

    def multiply(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            block = block.sort_values("vec_id")
            x, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                scores = products(np.stack(part["q"].to_numpy()), x)
                for row, asker, qid in zip(scores, part["asker"].to_numpy(), part["query_id"].to_numpy(), strict=True):
                    lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")
                    row, others = np.delete(row, slice(lo, hi)), np.delete(ids, slice(lo, hi))
                    order = (np.lexsort((others, -row)) if len(row) <= 4 * k else _top(row, others, k))[:k]
                    found.append(pd.DataFrame({"asker": asker, "query_id": qid, "vec_id": others[order], "score": row[order]}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("asker", "query_id", "vec_id", "score")})

    def visit(queries: DataFrame, annuli: str) -> DataFrame:
        # the asker goes into the exploded structs: beside the explode of a UDF's result, 4.1.2 loses columns
        to = F.transform(blocks_of(annuli), lambda t: F.struct(F.col("asker").alias("asker"), F.xxhash64(t["pivot"], t["ring"], t["part"]).alias("block")))
        visits = stored(queries.select(F.explode(to).alias("to")).select("to.asker", "to.block"), "visits")
        busy = visits.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > ASKED).withColumn("copies", F.ceil(F.col("n") / ASKED).cast("int"))
        busy = stored(busy, "busy")
        calm, split = hot_join(visits, busy, ["block"], how="left_anti"), hot_join(visits, busy, ["block"])
        lot = F.pmod(F.xxhash64("asker"), F.col("copies")).cast("int")
        dealt = calm.withColumn("lot", F.lit(0)).unionByName(split.select("asker", "block", lot.alias("lot")))
        sent = dealt.join(queries.select("asker", "query_id", "q"), "asker").select("asker", "query_id", "q", "block", "lot")
        copied = blocks.select("block", "vec_id", "v").join(busy.select("block", "copies"), "block", "left")
        copied = copied.withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        return sent.groupBy("block", "lot").cogroup(copied.groupBy("block", "lot")).applyInPandas(multiply, schema)

    started = stored(_best(visit(asked, "near"), k, "asker").drop("rank"), "first")
    reached = started.groupBy("asker").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bounded = asked.join(reached, "asker", "left").withColumn("worst", F.when(F.col("n") >= k, F.col("least").cast("double")))
    rest = visit(bounded.withColumn("far", further("q", "worst", "near")), "far")
    best = _best(started.unionByName(rest), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(row: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best scores, ties to the smaller id; ids ascend."""
    least = np.partition(row, len(row) - n)[len(row) - n]
    at = np.flatnonzero(row >= least)
    return at[np.lexsort((ids[at], -row[at]))]


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`search` of the whole table of embeddings; see there for nulls, ties, repeats and empty tables."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(rows, F.col("vec_id") % EVERY == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
