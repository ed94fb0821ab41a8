"""SimHash near-dedup through a segment-popcount embedding.

Fingerprint: bit b is 1 if more than half of a text's shingle hashes have it.

Link search: a fingerprint is cut to short segments, and embedded as the vector of their bit counts.  The
Manhattan distance of two vectors is at most the Hamming distance of the fingerprints, so pairs within
`radius` bits are found among pairs within `radius` of each other on the grid of count vectors.  The
segments form r // 3 + 1 bands; in one of them at least two linked fingerprints differ by two bits at most, so
there a range join of radius two suffices.  That join is done by meeting half-way: each distinct fingerprint
goes to its own grid cell and to the cells at distance one, 1 + 2 x segments rows a band, and two vectors
within distance two share a cell.  Segments are as short as two bits, so that a cell takes about one pair of
fingerprints in 100,000.  Inside a cell all pairs are tested for the exact Hamming distance, in numpy blocks; a cell of
more than `BLOCK` fingerprints is cut to parts, and each two parts are compared in a task of their own.  A cell returns
a spanning forest of its links, never all pairs, so no link between components is lost and large groups stay linear.
Components come from contracting the links round by round.

Exact copies meet before that: only distinct fingerprints are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, lots, small_batches, stored, table, unused, utf8

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Cells up to this many fingerprints are compared as one matrix, larger ones by search from one to the next.
MATRIX = 512
#: Fingerprints of a cell that are compared in one task; a larger cell is cut to parts of this many.
BLOCK = 1 << 18


def shingles(text: bytes, size: int = SHINGLE) -> list[int]:
    """Hashes of a text's shingles in order; a text of fewer words than `size` is one shingle, one without words none."""
    words = text.lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in spans]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits as a signed number; zero for a text without words."""
    return majority(shingles(text, size))


def majority(hashes: list[int]) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """`doc_id` and `fp` (long) of every row; null texts count as empty, and so get zero."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, size) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bands(radius: int) -> list[list[tuple[int, int]]]:
    """(first bit, width) of the segments of each band: as many bands as let two bits in one of them suffice."""
    n = radius // 3 + 1
    edges = [64 * i // n for i in range(n + 1)]
    width = 2 if n <= 2 else 3
    return [[(b, min(width, hi - b)) for b in range(lo, hi, width)] for lo, hi in zip(edges, edges[1:], strict=False)]


def cell_rows(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) rows: for each band the cell of the count vector and those at Manhattan distance one."""
    bits = fps.view(np.uint64)
    cells, owners = [], []
    for k, segments in enumerate(bands(radius)):
        base = np.full(len(bits), k + 1, dtype=np.int64)
        counts = []
        for first, width in segments:
            counts.append(np.bitwise_count((bits >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64))
            base = base * 6 + counts[-1] + 0
        cells.append(base)
        owners.append(fps)
        for j, (_, width) in enumerate(segments):
            weight = 6 ** (len(segments) - 1 - j)
            for step in (-1, 1):
                ok = (counts[j] + step >= 0) & (counts[j] + step <= width)
                cells.append(base[ok] + step * weight)
                owners.append(fps[ok])
    return np.concatenate(cells), np.concatenate(owners)


def cell_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one cell."""
    x = fps.view(np.uint64)
    links: list[tuple[int, int]] = []
    if len(x) <= MATRIX:
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
        root = list(range(len(x)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(i), top(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(fps[i]), int(fps[j])))
        return links
    rest = fps  # not yet reached
    while len(rest):
        reach, rest = [rest[0]], rest[1:]
        while reach and len(rest):
            u = reach.pop()
            near = np.bitwise_count(rest.view(np.uint64) ^ np.uint64(int(u) & 0xFFFFFFFFFFFFFFFF)) <= radius
            if near.any():
                found = rest[near]
                links += [(int(u), int(v)) for v in found]
                reach += list(found)
                rest = rest[~near]
    return links


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) rows that join all fingerprints within `radius` bits; `distinct` has one column `fp` without repeats."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, fp = cell_rows(batch.column("fp").to_numpy(zero_copy_only=False).copy(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], names=["cell", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if held and sum(map(len, held)) > 1:
                out.extend(cell_links(np.concatenate(held), radius))
            held.clear()

        def pop() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            cell, lot, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "lot", "fp"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(lot) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if hi > lo:
                    if (cell[lo], lot[lo]) != current:
                        flush()
                        current = (cell[lo], lot[lo])
                    held.append(fp[lo:hi].copy())
            if len(out) > 50_000:
                yield pop()
        flush()
        yield pop()

    rows = distinct.mapInArrow(spread, "cell long, fp long")
    # no cell has more fingerprints than there are; only beyond that are cells counted
    dealt = rows.withColumn("lot", F.lit(0).cast("long")) if distinct.count() <= BLOCK else lots(rows, "cell", "fp", BLOCK)
    cells = dealt.repartition("cell", "lot").sortWithinPartitions("cell", "lot", "fp")
    return cells.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links; root is the least node of the component.

    Each round merges every node into its least neighbour and follows those pointers once more, then rewrites
    the links.  A round ends at least the node that is the largest of its component; in practice few rounds do.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while live.take(1):
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        parent = stored(parent, "parents")
        twice = parent.alias("p").join(parent.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        step = stored(twice, "steps")
        if roots is None:
            roots = step.select("node", F.col("up").alias("root"))
        else:
            roots = roots.join(step.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            roots = stored(roots, "roots")
        left = live.join(step.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(step.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        live = stored(left.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return roots


def near_copies(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`doc_id`, `fp` and `component_id` of every row of `documents`.

    component_id is the least doc_id that links reach, through equal fingerprints or those within `radius` bits.
    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows come out repeated;
    rows with a null doc_id take part in links and get the least known id of their component, or null.  An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    rows = stored(fingerprints(documents, size), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    tree = components(links(least.select("fp"), radius))
    rooted = least.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "lowest")
    by_print = stored(hot_join(rooted, lowest, ["root"], n="m").select("fp", "component_id", "n"), "by-print")
    return hot_join(rows, by_print, ["fp"]).drop("n")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by `near_copies`; see there for nulls, repeats and empty tables."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The pipeline's stage: five words; links of up to seven bits are one source of candidates, min-hash bands the other.
STAGE_SHINGLE, STAGE_RADIUS = 5, 7
#: Two texts are near copies from this shingle similarity on, as a fraction.
ALIKE = (4, 5)
#: Bands of min-hashes, and min-hashes a band: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
_DRAWN = np.random.default_rng(SEED)
MASKS = _DRAWN.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _DRAWN.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed number a band, of the least of each of its permutations of the hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 14):
        np.minimum(least, ((hashes[at : at + (1 << 14)] ^ MASKS) * FACTORS).min(1), out=least)
    return [_signed(xxhash.xxh64_intdigest(part.tobytes(), k)) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def alike_links(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets of hashes that are `ALIKE`; no set is empty."""
    part, whole = ALIKE
    sizes = np.array([len(x) for x in sets])
    rest = np.arange(1, len(sets))
    reach, found = [0], []
    flat = None
    while len(rest):
        if not reach:
            reach, rest, flat = [int(rest[0])], rest[1:], None
            continue
        u = reach.pop()
        if flat is None:
            flat = np.concatenate([sets[i] for i in rest])
            starts = np.concatenate(([0], np.cumsum(sizes[rest])[:-1]))
        x = sets[u]
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), starts)
        near = common * whole >= part * (sizes[u] + sizes[rest] - common)
        if near.any():
            found += [(keys[u], keys[i]) for i in rest[near]]
            reach += rest[near].tolist()
            rest, flat = rest[~near], None
    return found


#: Sets of a bucket that are compared in one task; a larger bucket is cut to parts of this many.
SETS = 2000


def verified_links(members: DataFrame, shingles_: DataFrame) -> DataFrame:
    """(a, b) rows that join all keys of a bucket whose shingles are alike; `members`: bucket, key; `shingles_`: key, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, sets = None, [], []

        def flush() -> pa.RecordBatch:
            found = alike_links(keys, sets) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, lot, key, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lot", "key", "set")), strict=True):
                if (bucket, lot) != current:
                    if len(keys) > 1:
                        yield flush()
                    current, keys, sets = (bucket, lot), [], []
                keys.append(key)
                sets.append(np.frombuffer(raw, "<u8"))
        yield flush()

    dealt = lots(members, "bucket", "key", SETS).join(shingles_, "key").repartition("bucket", "lot").sortWithinPartitions("bucket", "lot")
    return dealt.select("bucket", "lot", "key", "set").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def alike_rows(rows: DataFrame) -> DataFrame:
    """`key`, `doc_id`, `body` (hash of the text) and `group` of every row of `rows` (key, doc_id, text).

    Rows of one group are joined by links of shingle similarity `ALIKE` at least.  Rows of equal shingle sets
    meet first, by digest.  Candidates are the components of fingerprints within `STAGE_RADIUS` bits, and the sets
    that share a min-hash band: fingerprints of similar texts can differ by more bits than a search can cover.
    All pairs of a bucket are candidates, and each link is verified on the shingles themselves, at most twice
    `SETS` of a bucket in one task.
    """
    spark = rows.sparkSession
    small_batches(spark)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, bands_ = [], [], []
            for text in utf8(batch.column("text")):
                hashes = shingles(text, STAGE_SHINGLE)
                distinct = np.unique(np.array(hashes, dtype="<u8"))
                fps.append(majority(hashes) if hashes else 0)
                digests.append(xxhash.xxh128_digest(distinct.tobytes()))
                bands_.append(band_keys(distinct) if hashes else [])
            names = ["key", "doc_id", "body", "fp", "digest", "bands"]
            arrays = [batch.column("key"), batch.column("doc_id"), batch.column("body"), pa.array(fps, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands_, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(shingles(t, STAGE_SHINGLE), dtype="<u8")).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "set"])

    read = rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    marks = stored(read.mapInArrow(mark, "key long, doc_id long, body long, fp long, digest binary, bands array<long>"), "marks")
    first = stored(marks.groupBy("digest").agg(F.min(F.struct("key", "fp", "bands")).alias("r"), F.count("*").alias("n")).select("digest", "r.*", "n"), "sets")
    some = first.where(F.size("bands") > 0)
    tree = components(links(some.select("fp").distinct(), STAGE_RADIUS)).withColumnRenamed("node", "fp")
    by_bits = some.join(tree, "fp", "left").select(F.xxhash64(F.lit("bits"), F.coalesce("root", "fp")).alias("bucket"), "key")
    # a key is in one row of `some`, so equal bands of a row are all that could repeat
    by_bands = some.select(F.explode(F.array_distinct("bands")).alias("bucket"), "key")
    held = stored(by_bits.unionByName(by_bands), "buckets")
    mixed = F.xxhash64("key")
    # buckets of the same members are verified once
    shared = held.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(mixed).alias("x"), F.sum(F.pmod(mixed, F.lit(1 << 31))).alias("y")).where("n > 1")
    once = stored(shared.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "once")
    members = stored(hot_join(held, once, ["bucket"]).select("bucket", "key"), "members")
    of_members = stored(rows.select("key", "text").join(members.select("key").distinct(), "key", "left_semi").mapInArrow(sets, "key long, set binary"), "shingles")
    found = components(stored(verified_links(members, of_members), "alike"))
    grouped = first.select("digest", "key", "n").join(found.withColumnRenamed("node", "key"), "key", "left").select("digest", F.coalesce("root", "key").alias("group"), "n")
    return hot_join(marks, stored(grouped, "grouped"), ["digest"]).select("key", "doc_id", "body", "group")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id, rows without one last, then by hash of the text.

    Rows are told apart by a key of their own, so null and repeated ids are rows like any other.  Texts without
    words are alike; an empty table gives no rows; columns of the table named like any in here are kept.
    """
    row = unused(docs, "__key")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = stored(alike_rows(rows.select(F.col(row).alias("key"), "doc_id", "text")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "body", "key")
    keep = found.groupBy("group").agg(F.min(order).alias("best")).select(F.col("best.key").alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)
