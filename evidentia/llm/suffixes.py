"""Suffix-array dedup by bucket-pointer refinement, over the bytes of a whole corpus.

Every byte goes that is covered by a string of `length` bytes which also starts anywhere else; or, of each such
string, every start but the first in the corpus.  A suffix array sorted only `length` bytes deep, and only where
suffixes can meet, answers that.  Buckets are refined round by round, each round by the bucket identifiers of later offsets:

1. Initial buckets are q-grams of `GRAM` bytes.  Identifiers come from doubling: that of the 2w bytes at a place is
   made of those of w bytes there and at offset w.  Every window of `length` bytes points to one bucket, that of its
   least q-gram (leftmost of equals).  Equal windows hence point to equal buckets at equal offsets.  Consecutive
   windows that point to the same place form a run; a run whose bucket has one member is done: its windows are unique.
2. The windows of the other runs are cut to cells of `CELL` offsets.  Their bucket is refined by the identifier of
   the cell's core (the bytes that all its windows share), made of those of 64, 128 and 256 bytes at the core's start and at the
   later offset where the last of them fits; then by that of the hull (all bytes of its windows).  A core met once makes
   all its windows unique, a hull met twice makes all of them repeated.
3. What is left, cells at the ends of repeated passages, is refined to single windows within the core's bucket, by
   the same identifiers at each window's own later offsets: one row per distinct hull.  Buckets of more than `MAX_BUCKET` hulls are
   refined by a Spark aggregation instead of in one task.

What equality rests on: in step 2 on 64 bits of the core and 64 bits of the hull, by two hash functions; in
step 3 windows of equal identifiers are compared byte by byte (in buckets beyond `MAX_BUCKET`: 128 bits).

Exact copies of whole texts are settled first, by a 128-bit digest; one of each takes part in the rest.  Text is
shuffled once in whole, later only for documents that have a bucket in common with another.  A bucket or text that
very many rows share is joined by broadcast (`common.hot_join`), never dealt to one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, small_batches, stored, table, utf8

LENGTH, GRAM, CELL = 400, 64, 85
#: The pipeline's stage: a passage of over 50 words has this many bytes (of 51 words at 99 places in 100 it has 240).
STAGE_LENGTH = 200
MAX_BUCKET = 50_000
#: Windows of a text handled at a time; bounds the memory of a task on giant texts.
PIECE = 1 << 20
#: A piece with fewer windows than this to a run has a short period; its equal windows are settled within it.
DENSE = 16
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP, _ALL = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFFFFFFFFFF)
#: How texts are cut and identified, as the arrays that `runs` returns.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a bucket from those of its first and its later half."""
    x = (a * _K1) ^ ((b * _K2) >> np.uint64(31)) ^ ((b * _K2) << np.uint64(33))
    x ^= x >> np.uint64(29)
    x *= _K3
    return x ^ (x >> np.uint64(32))


def gram_ids(text: bytes) -> np.ndarray:
    """The bucket identifier of the `GRAM`-gram at each position."""
    n = len(text) - 7
    ids, padded = np.empty(n, np.uint64), text + bytes(8)
    for first in range(8):
        count = (n - first + 7) // 8
        if count > 0:
            ids[first::8] = np.frombuffer(padded, "<u8", count=count, offset=first)
    ids = _paired(ids, ids ^ _K3)
    width = 8
    while width < GRAM:
        ids = _paired(ids[:-width], ids[width:])
        width *= 2
    return ids


class Deeper:
    """Identifiers of more than `GRAM` bytes at the places of a text, from those of the grams."""

    def __init__(self, ids: np.ndarray):
        self.by_width = {GRAM: ids}

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Of the `length` bytes at `starts`: of the widest doubling that fits, there and where it fits last."""
        width = GRAM
        while 2 * width <= length:
            if 2 * width not in self.by_width:
                ids = self.by_width[width]
                self.by_width[2 * width] = _paired(ids[:-width], ids[width:])
            width *= 2
        ids = self.by_width[width]
        return _paired(ids[starts], ids[starts + length - width])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, _ALL)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int = LENGTH, keep_first: bool = False) -> Runs:
    """(bucket, its position, first window, last window) of the runs of windows of a text, and spans settled here.

    In a piece of short period nearly every window is a run of its own; of its equal windows only the first goes
    on, and the spans of those that repeat it (of all of them, unless `keep_first`) are returned.
    """
    offsets = length - GRAM + 1
    buckets, places, firsts, lasts = [], [], [], []
    own: list[tuple[int, int]] = []
    windows = len(text) - length + 1
    for at in range(0, max(windows, 0), PIECE):
        ids = gram_ids(text[at : min(at + PIECE, windows) + length - 1])
        place = (_sliding_least((ids & _TOP) | np.arange(len(ids), dtype=np.uint64), offsets) & ~_TOP).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts - 1, [len(place) - 1]))
        if len(place) > 4 * length and len(first) * DENSE > len(place):
            _, nth, where, often = np.unique(Deeper(ids).at(np.arange(len(place)), length), return_index=True, return_inverse=True, return_counts=True)
            repeats = np.arange(len(place)) != nth[where] if keep_first else often[where] > 1
            own += _window_spans((np.flatnonzero(repeats) + at).tolist(), length)
            first = last = np.sort(nth)
        buckets.append(ids[place[first]])
        places.append(place[first] + at)
        firsts.append(first + at)
        lasts.append(last + at)
    if not buckets:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, own
    bucket, place, first, last = (np.concatenate(x) for x in (buckets, places, firsts, lasts))
    # a run goes on over the seam of two pieces
    new = np.concatenate(([True], (np.diff(place) != 0) | (first[1:] != last[:-1] + 1)))
    ends = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(place) - 1]))
    return bucket[new], place[new], first[new], last[ends], own


def cells(text: bytes, places: list[int], firsts: list[int], lasts: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(core, hull, first window, last window) of the cells of some runs.

    A hull that would reach over an end of the text equals no other; it gets an identifier from its place.
    """
    digest = xxhash.xxh3_64_intdigest
    whole = xxhash.xxh3_128_digest(text)
    most = length - GRAM
    at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for place, first, last in zip(places, firsts, lasts, strict=True):
        for k in range((place - last) // CELL, (place - first) // CELL + 1):
            at[k].append((place, first, last))
    if not at:
        return
    for lo in range(0, len(text) - GRAM + 1, PIECE):  # cores that start in this piece
        deeper = None
        for k, found in at.items():
            near, far = k * CELL, min(k * CELL + CELL - 1, most)
            core = length - far + near
            mine = [f for f in found if lo <= max(f[0] - near, 0) < lo + PIECE]
            if not mine:
                continue
            if deeper is None:
                deeper = Deeper(gram_ids(text[lo : lo + PIECE + length]))
            # where the nearest windows of a cell would start before the text, its core is cut there: a length of its own
            whole_cores = [f for f in mine if f[0] - near >= 0 and f[0] - far + length <= len(text)]
            ids = dict(zip(whole_cores, deeper.at(np.array([f[0] - near - lo for f in whole_cores], dtype=np.int64), core).tolist(), strict=True)) if whole_cores else {}
            for f in mine:
                place, first, last = f
                id_ = ids[f] if f in ids else digest(text[max(place - near, 0) : place - far + length], k)
                start, end = place - far, place - near + length
                inside = start >= 0 and end <= len(text)
                hull = digest(text[start:end], k) if inside else digest(whole + place.to_bytes(8, "little"), k + 1000)
                yield (id_ + k) & 0xFFFFFFFFFFFFFFFF, hull, max(first, start), min(last, place - near)


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64())


def _window_spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    """The byte spans that windows at ascending starts cover, joined where they touch."""
    spans: list[tuple[int, int]] = []
    for s in starts:
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], s + length)
        else:
            spans.append((s, s + length))
    return spans


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digest_pair(text: bytes) -> tuple[int, int]:
    key = xxhash.xxh3_128_digest(text)
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _profile(documents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """One row per row of `documents`: id, digest of the text, length, SHA-256, and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            found = [runs(t, length, keep_first) for t in texts]
            keys = [digest_pair(t) for t in texts]
            sizes = np.concatenate(([0], np.cumsum([len(r[0]) for r in found]))).astype(np.int32)
            flat = [np.concatenate([r[i] for r in found]) for i in range(4)] if found else [np.zeros(0)] * 4
            flat = [flat[0].view(np.int64), *(x.astype(np.int32) for x in flat[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(x)) for x in flat]
            columns = [
                batch.column("doc_id"),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                *lists,
                pa.array([[{"a": a, "b": b} for a, b in r[4]] for r in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_bytes", "sha256", "buckets", "places", "firsts", "lasts", "own"])

    schema = "doc_id long, k1 long, k2 long, n_bytes long, sha256 string, buckets array<long>, places array<int>, firsts array<int>, lasts array<int>, own array<struct<a:long,b:long>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def repeated_spans(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The decisions: (rows, texts, spans).

    rows: doc_id, row_id, k1, k2, n_bytes, sha256, `copies` (rows with this text) and `least` (the least row_id of
    those) of each row of `documents`; texts: did, k1, k2, text of those that lose something or may; spans: did and
    its array of (a, b) to remove.  With `keep_first` the first of equal windows stays, in the order of row_id,
    then of the text's digest, then of position.
    """
    spark = documents.sparkSession
    small_batches(spark)
    ids = F.coalesce("doc_id", F.xxhash64("k1", "k2"))
    profile = _profile(documents, length, keep_first).withColumns({"pid": F.monotonically_increasing_id(), "row_id": ids})
    profile = stored(profile, "profile")
    first = F.min(F.struct("row_id", "pid"))
    by_text = profile.groupBy("k1", "k2").agg(F.count("*").alias("copies"), first["row_id"].alias("least"), first["pid"].alias("one"))
    by_text = stored(by_text, "texts")

    # one row of each text takes part: only the others' numbers are joined, not what the texts were cut to
    copied = stored(by_text.where("copies > 1"), "copied")
    others = hot_join(profile.select("pid", "k1", "k2"), copied, ["k1", "k2"], n="copies").where("pid <> one").select("pid")
    one = profile.join(stored(others, "others"), "pid", "left_anti")
    one_runs = one.select("pid", F.explode(F.arrays_zip("buckets", "places", "firsts", "lasts")).alias("r"))
    one_runs = one_runs.select("pid", F.col("r.buckets").alias("bucket"), F.col("r.places").alias("place"), F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"))
    one_runs = stored(one_runs, "runs")
    shared = stored(one_runs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    wanted = hot_join(one_runs, shared, ["bucket"], how="left_semi").groupBy("pid").agg(F.collect_list(F.struct("place", "first", "last")).alias("runs"))
    settled_here = one.where(F.size("own") > 0).select("pid", "own")
    known = profile.select("pid", "doc_id", "row_id", "k1", "k2")
    wanted = wanted.join(settled_here, "pid", "full").join(known, "pid").drop("pid", "doc_id")
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the digest is worked out in Python; rows without an id are found by it
    whole = _digested(whole)

    found = whole.join(wanted, ["row_id", "k1", "k2"])
    if keep_first:  # the join has dealt the rows by these columns
        found = found.dropDuplicates(["row_id", "k1", "k2"])
    found = found.withColumn("did", F.monotonically_increasing_id())
    texts = stored(found, "shared-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            columns = (batch.column(c).to_pylist() for c in ("did", "row_id", "k1", "runs"))
            for text, did, row_id, k1, rs in zip(utf8(batch.column("text")), *columns, strict=True):
                order = (row_id, k1) if keep_first else (0, 0)
                for core, hull, first, last in cells(text, [r["place"] for r in rs], [r["first"] for r in rs], [r["last"] for r in rs], length):
                    for i, v in enumerate((did, *order, core, hull, first, last)):
                        out[i].append(v)
            columns = [*(pa.array(x, pa.int64()) for x in out[:3]), _signed(out[3]), _signed(out[4]), *(pa.array(x, pa.int64()) for x in out[5:])]
            yield pa.RecordBatch.from_arrays(columns, names=["did", "row_id", "k1", "core", "hull", "first", "last"])

    rows = texts.where("runs IS NOT NULL").select("did", "row_id", "k1", "text", "runs").mapInArrow(cut, "did long, row_id long, k1 long, core long, hull long, first long, last long")
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "cells")
    foremost = F.min(F.struct("row_id", "k1", "first", "rid")) if keep_first else F.min(F.struct("rid"))
    hulls = stored(rows.groupBy("core", "hull").agg(F.count("*").alias("n"), foremost["rid"].alias("rid")), "hulls")
    cores = hulls.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("hulls"), F.count_if(F.col("n") == 1).alias("single"))
    open_cores = stored(cores.where("hulls > 1" if keep_first else "total > 1 AND single > 0").select("core", "hulls"), "cores")

    twice = stored(hulls.where("n > 1").select("core", "hull", "n", F.col("rid").alias("foremost")), "twice")
    settled = hot_join(rows, twice, ["core", "hull"])
    if keep_first:
        settled = settled.where("rid <> foremost")
    settled = settled.select("did", F.struct(F.col("first").alias("a"), (F.col("last") + length).alias("b")).alias("span"))

    asked = hot_join(hulls, open_cores, ["core"], n="hulls").select("rid", "n", "hulls").join(rows, "rid")
    asked = asked.groupBy("did").agg(F.collect_list(F.struct("row_id", "k1", "core", "n", "hulls", "first", "last")).alias("cells"))
    names = ["did", "row_id", "k1", "core", "n", "hulls", "first"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for did, text, cs in zip(batch.column("did").to_pylist(), utf8(batch.column("text")), batch.column("cells").to_pylist(), strict=True):
                for c in cs:
                    for i, v in enumerate((did, *(c[x] for x in names[1:]), text[c["first"] : c["last"] + length])):
                        out[i].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.binary())], names=[*names, "part"])

    schema = ", ".join(f"{x} long" for x in names) + ", part binary"
    parts = stored(texts.select("did", "text").join(asked, "did").mapInArrow(fetch, schema), "parts")
    order = ["row_id", "k1", "first", "did"] if keep_first else ["did", "first"]
    exact = parts.where(F.col("hulls") <= MAX_BUCKET).repartition("core").sortWithinPartitions("core", *order).mapInArrow(_refine(length, keep_first), "did long, a long, b long")
    wide = parts.where(F.col("hulls") > MAX_BUCKET)
    windows = wide.mapInArrow(_windows(length), "did long, row_id long, k1 long, core long, n long, start long, w1 long, w2 long")
    key = ["core", "w1", "w2"]
    if keep_first:
        place = F.struct("row_id", "k1", "start", "did")
        met = windows.groupBy(*key).agg(F.count("*").alias("met"), F.min(place).alias("foremost")).where("met > 1")
        again = windows.join(met, key).where(place != F.col("foremost"))
    else:
        again = windows.where("n = 1").join(windows.groupBy(*key).agg(F.count("*").alias("met")).where("met > 1"), key, "left_semi")
    wide_spans = again.select("did", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    refined = exact.unionByName(wide_spans).select("did", F.struct("a", "b").alias("span"))
    here = texts.where("own IS NOT NULL").select("did", F.explode("own").alias("span"))
    spans = settled.unionByName(refined).unionByName(here).groupBy("did").agg(F.collect_list("span").alias("spans"))
    rows_out = hot_join(profile.select("doc_id", "row_id", "k1", "k2", "n_bytes", "sha256"), by_text, ["k1", "k2"], n="copies").drop("one")
    return rows_out, texts.select("did", "k1", "k2", "text"), spans


def _digested(whole: DataFrame) -> DataFrame:
    """row_id, k1, k2 and text of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest_pair(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column("text")], names=["doc_id", "k1", "k2", "text"])

    out = whole.mapInArrow(run, "doc_id long, k1 long, k2 long, text string")
    return out.select(F.coalesce("doc_id", F.xxhash64("k1", "k2")).alias("row_id"), "k1", "k2", "text")


def _refine(length: int, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each core's bucket: the windows to remove, as spans.

    Windows are bucketed by their identifiers of later offsets, and those of one bucket compared with its first.  Without
    `keep_first` only rows whose hull is met once are asked for; with it all rows but each window's first.
    """

    def repeats(parts: list[bytes]) -> list[list[int]]:
        """For each part the offsets of its windows that another window of the bucket equals, or an earlier one."""
        sizes = [len(p) - length + 1 for p in parts]
        ids = np.concatenate([Deeper(gram_ids(p)).at(np.arange(n), length) for p, n in zip(parts, sizes, strict=True)])
        _, nth, where, often = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)
        out: list[list[int]] = [[] for _ in parts]

        def window(i: int) -> tuple[int, int, bytes]:
            owner = int(np.searchsorted(ends, i, "right"))
            offset = i - int(ends[owner]) + sizes[owner]
            return owner, offset, parts[owner][offset : offset + length]

        confirmed: set[int] = set()
        for i in np.flatnonzero(often[where] > 1).tolist():
            first = int(nth[where[i]])
            owner, offset, here = window(i)
            if i == first:
                continue
            if here == window(first)[2]:
                out[owner].append(offset)
                confirmed.add(first)
        if not keep_first:
            for i in sorted(confirmed):
                owner, offset, _ = window(i)
                out[owner].append(offset)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        out: list[tuple[int, int, int]] = []
        current = None

        def flush() -> None:
            if len(held) > 1:
                for (did, n, first, _), offsets in zip(held, repeats([h[3] for h in held]), strict=True):
                    if keep_first or n == 1:
                        out.extend((did, a, b) for a, b in _window_spans([first + o for o in sorted(offsets)], length))
            held.clear()

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["did", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for core, did, n, first, part in zip(*(batch.column(c).to_pylist() for c in ("core", "did", "n", "first", "part")), strict=True):
                if core != current:
                    flush()
                    current = core
                held.append((did, n, first, part))
            yield taken()
        flush()
        yield taken()

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "row_id", "k1", "core", "n"]
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(8)]
            for *same, first, part in zip(*(batch.column(c).to_pylist() for c in (*names, "first", "part")), strict=True):
                count = len(part) - length + 1
                at = np.arange(count)
                second = np.array([xxhash.xxh3_64_intdigest(part[o : o + length]) for o in range(count)], dtype=np.uint64)
                made = [*(np.full(count, v, np.int64) for v in same), first + at, Deeper(gram_ids(part)).at(at, length).view(np.int64), second.view(np.int64)]
                for column, values in zip(columns, made, strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns], names=[*names, "start", "w1", "w2"])

    return run


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def cut_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept (bytes) of each text that loses some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_ = [joined([(s["a"], s["b"]) for s in ss]) for ss in batch.column("spans").to_pylist()]
            kept = [without(t, r) for t, r in zip(utf8(batch.column("text")), runs_, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array([sum(b - a for a, b in r) for r in runs_], pa.int64()), pa.array([len(r) for r in runs_], pa.int64()), pa.array(kept, pa.binary())],
                names=["k1", "k2", "n_removed", "n_spans", "kept"],
            )

    both = texts.join(spans, "did").select("k1", "k2", "text", "spans")
    return both.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary").dropDuplicates(["k1", "k2"])


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `documents`.

    Texts are taken as UTF-8, null as empty.  A text of `length` bytes or more that another row repeats goes
    as a whole.  Windows never cross rows.  Repeated rows and null ids come out as they came in; ties can't arise,
    as all of several equal strings go; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows, texts, spans = repeated_spans(documents.select("doc_id", "text"), length)
    cut = cut_texts(texts, spans).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    single = rows.where(~gone).join(cut, ["k1", "k2"], "left")
    single = single.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
    copied = rows.where(gone).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return single.unionByName(copied)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = STAGE_LENGTH) -> DataFrame:
    """The documents without the passages of `length` bytes or more that an earlier place has too; `n_chars` follows the text.

    Of equal passages the first stays, in the order of doc_id, rows without one by a hash of their text.  A document
    whose whole text is cut goes; so do further rows of one id and text.  Null and short texts stay as they are.
    Where a cut falls inside a character, what is left of that character goes too.
    """
    rows, texts, spans = repeated_spans(docs.select("doc_id", "text"), length, keep_first=True)
    joined_spans = texts.join(spans, "did").select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    long_copy = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    by_row = rows.groupBy("row_id", "k1", "k2").agg(F.max(long_copy & (F.col("row_id") != F.col("least"))).alias("gone"), (F.max(long_copy) & (F.count("*") > 1)).alias("twins"))
    wanted = by_row.join(joined_spans, ["k1", "k2"], "left").where("gone OR twins OR spans IS NOT NULL")
    per_row = wanted.groupBy("row_id").agg(F.collect_list(F.struct("k1", "k2", "gone", "twins", "spans")).alias("__cuts"))
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, stay = [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("__cuts").to_pylist(), strict=True):
                stays = True
                if cuts:
                    raw = (text or "").encode()
                    mine = digest_pair(raw)
                    for c in cuts:
                        if (c["k1"], c["k2"]) == mine:
                            text = "" if c["gone"] else without(raw, joined([(s["a"], s["b"]) for s in c["spans"] or ()])).decode("utf-8", "ignore")
                            stays = bool(text.strip())
                kept.append(text)
                stay.append(stays)
            columns = []
            for field in schema.fields:
                if field.name == "text":
                    columns.append(pa.array(kept, pa.string()))
                elif field.name == "n_chars":
                    columns.append(pa.array([None if t is None else len(t) for t in kept], batch.column("n_chars").type))
                else:
                    columns.append(batch.column(field.name))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields]).filter(pa.array(stay, pa.bool_()))

    # a null id has no row_id without its digest: such rows, few as a rule, are keyed in Python
    keyed = docs.withColumn("__row", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").unionByName(_keyed_by_text(docs.where("doc_id IS NULL")))
    with_cuts = keyed.join(per_row.withColumnRenamed("row_id", "__row"), "__row", "left")
    twins = F.exists(F.coalesce("__cuts", F.array()), lambda c: c["twins"])
    one_each = with_cuts.where(twins).dropDuplicates(["__row", "text"])
    return with_cuts.where(~twins).unionByName(one_each).drop("__row").mapInArrow(cut, schema)


def _keyed_by_text(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest_pair(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=[*batch.schema.names, "__k1", "__k2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __k1 long, __k2 long"
    return docs.mapInArrow(run, schema).withColumn("__row", F.xxhash64("__k1", "__k2")).drop("__k1", "__k2")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`dedup` of the whole table of documents, at `LENGTH` bytes; see there for nulls, copies and empty tables."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
