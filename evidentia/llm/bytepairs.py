"""Byte-level BPE encoding and decoding by a file of ranks, with long texts cut to overlapping chunks.

Encoding: a text is cut to pre-tokens by a pattern, and in each the neighbouring pair of the least rank is merged, the leftmost of equals,
until no pair has a rank.  The pattern looks no further back than the start of a match and two characters ahead of its end, so two
pre-tokenisations that share one boundary agree from there on.

Texts of more than a chunk and its overlap are cut to chunks of `CHUNK` bytes, each read `OVERLAP` bytes into the next one and
pre-tokenised by itself, all in parallel.  A chunk that starts inside a pre-token may begin wrong.  The boundaries that
the chunk before it made inside the overlap are compared with its own: from the first one in common it is right, the chunk before
ends there, and what lies between two such stitches is a piece.  Pieces are then encoded from the pre-tokens at hand, in
parallel.  Where two chunks share no boundary, as in a run of letters longer than the overlap, the text is cut anew to
chunks and overlaps of twice the length, until all chunks meet or the text is one; so the ids never depend on where it was cut.

Only boundaries inside overlaps are brought together; the pieces of a text are put in order, and hashed, as a stream of rows.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Characters after a boundary without which it isn't certain: a contraction may take two more.
AHEAD = 2
#: Bytes from which on the pairs of a word are merged by a heap; pre-tokens shorter than that, which a worker remembers.
HEAP, KNOWN = 64, 400_000
#: Words merged side by side; the rank of a pair that makes no token.
TOGETHER, NEVER = 100_000, np.int64(1) << 40
# Letters and digits of editions 17 and 18 of Unicode, code points from-to; the merges' library (edition 16) has them as neither.
LATER_RANGES = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER = "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER_RANGES.split()) + "]"
#: A character for private use stands for them when texts are cut: no letter, digit or blank either.
UNASSIGNED = "\ue000"
PARTS = "row long, doc_id long, part int, parts int, ids binary"


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Text to pre-tokens.  What later editions of Unicode have made letters or digits than the merges' library knows is neither."""
    find, later = regex.compile(pattern), regex.compile(LATER).search

    def cut(text: str) -> list[str]:
        if text.isascii() or not later(text):
            return find.findall(text)
        plain = regex.sub(LATER, UNASSIGNED, text)
        return [text[m.start() : m.end()] for m in find.finditer(plain)]

    return cut


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Pre-tokens to ids as little-endian unsigned 32-bit integers; those that are met again are worked out once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.known = ranks, {}
        self.cut = cutter(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # every pair of tokens that makes a token, and the rank it makes
        pairs = [(ranks[t[:i]] * len(self.tokens) + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pairs, self.made = np.append(keys[order], np.int64(-1)), np.append(made[order], NEVER)

    def encoded(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as lists of pre-tokens."""
        known, ahead = self.known, {}
        new = set().union(*texts) - known.keys()
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set().union(*texts)
        words = [(p, p.encode()) for p in new]
        for p, raw in words:
            if raw in self.ranks:
                known[p] = np.array([self.ranks[raw]], "<u4").tobytes()
            elif len(raw) >= HEAP:
                ahead[p] = np.array(self.by_heap(raw), "<u4").tobytes()
        rest = [(p, raw) for p, raw in words if p not in known and p not in ahead]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            known.update(zip([p for p, _ in some], self.merged([raw for _, raw in some]), strict=True))
        if not ahead:
            return [b"".join([known[p] for p in text]) for text in texts]
        return [b"".join([known[p] if p in known else ahead[p] for p in text]) for text in texts]

    def decoded(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of tokens make, `NEVER` where nothing."""
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pairs[:-1], key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NEVER)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, none empty: in each turn every word merges its pair of the least rank, the leftmost of equals."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        # made[i]: the rank of the pair that starts with i; the last of a word starts none
        made = np.append(self.rank_of(ids[:-1], ids[1:]), NEVER)
        made[np.cumsum(lengths) - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(made, first)
            sizes = np.diff(np.append(first, len(ids)))
            open_ = np.repeat(least < NEVER, sizes)
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, made = ids[open_], word[open_], made[open_]
                sizes, least = sizes[least < NEVER], least[least < NEVER]
                if not len(ids):
                    break
                first = np.append(0, np.cumsum(sizes)[:-1])
            hits = np.flatnonzero(made == np.repeat(least, sizes))
            at = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            ids[at] = made[at]
            # the second of the pair goes; the pairs that the new token ends and starts are looked up
            starts = at == first
            ends = (at + 1) == (first + sizes - 1)
            before, after = at[~starts], at[~ends]
            made[before - 1] = self.rank_of(ids[before - 1], ids[before])
            made[after] = self.rank_of(ids[after], ids[np.minimum(after + 2, len(ids) - 1)])
            made[at[ends]] = NEVER
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, word, made = ids[stay], word[stay], made[stay]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        raw, ends = ids[order].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def by_heap(self, piece: bytes) -> list[int]:
        """The same for one long word in n log n: parts are linked, and a pair that has changed since it was queued is passed over."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by where it starts; `end` is also the next one's start
        rank_at = [-1] * n
        heap: list[tuple[int, int]] = []

        def queue(at: int) -> None:
            rank_at[at] = ranks.get(piece[at : end[end[at]]], -1) if end[at] < n else -1
            if rank_at[at] >= 0:
                heapq.heappush(heap, (rank_at[at], at))

        for at in range(n):
            queue(at)
        while heap:
            rank, at = heapq.heappop(heap)
            if rank_at[at] != rank:
                continue
            gone = end[at]
            end[at], rank_at[gone] = end[gone], -1
            if end[at] < n:
                before[end[at]] = at
            queue(at)
            if before[at] >= 0:
                queue(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out


#: The coder last used in a worker, kept from task to task.
_CODERS: dict[str, Coder] = {}


class Vocabulary:
    """Ranks and pattern as tasks get them: read on the driver once, sent to the executors; as large as the file, whatever the texts."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.name = uuid.uuid4().hex
        self.sent: Broadcast = spark.sparkContext.broadcast((read_ranks(path or public_tokenizers.path(VOCABULARY)), pattern))

    def coder(self) -> Coder:
        if self.name not in _CODERS:
            _CODERS.clear()
            _CODERS[self.name] = Coder(*self.sent.value)
        return _CODERS[self.name]


def arrays(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch of `rows` under a DDL schema of longs, ints, binaries and arrays of longs or ints."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def chunk_boundaries(coder: Coder, chunk: bytes, no: int, length: int, overlap: int, last: bool) -> tuple[int, int, list[int], list[int], list[int]]:
    """(start, bytes skipped before it, lengths of the pre-tokens, boundaries in the overlap with the chunk before, and in that with the next), in bytes of the text.

    The chunk starts with the first whole character at or after no * length and ends with the last whole one.
    """
    skip = 0
    if no:
        while skip < len(chunk) and chunk[skip] & 0xC0 == 0x80:
            skip += 1
    text = chunk[skip:].decode("utf-8", "ignore")
    found = coder.cut(text)
    sizes = [len(p.encode()) for p in found]
    start = no * length + skip
    starts = (start + np.concatenate([[0], np.cumsum(sizes)]))[:-1].astype(np.int64)
    head = starts[starts < no * length + overlap] if no else starts[:0]
    # certain are those with enough characters behind them
    sure = starts[: 0 if last else None]
    if len(sure):
        behind = len(text) - np.concatenate([[0], np.cumsum([len(p) for p in found])])[:-1]
        sure = sure[(behind >= AHEAD) & (starts >= (no + 1) * length)]
    return start, skip, sizes, head.tolist(), sure.tolist()


def encode(documents: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Two tables of row, doc_id, part, parts, ids: those of short and of long texts of `documents` (doc_id, text).

    The ids of a text, little-endian 32-bit, lie in `parts` rows by `part`; the short texts' are one row each.  The tables are apart because a
    user of only one then pays for no other; their union is the whole.

    `row` tells rows of one doc_id apart.  A text of up to chunk + overlap bytes is one part, made where it is read.  A null text is empty; an
    empty one has one part without ids.  Bytes that are not UTF-8 count as U+FFFD.  Null and repeated doc_ids are documents of
    their own, other columns are not read, and an empty table gives no rows.  A single pre-token is merged in one task, however long.
    """
    small_batches(documents.sparkSession)
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    short = F.octet_length("text") <= chunk + overlap

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            ids = coder.encoded([coder.cut(t) for t in batch.column("text").to_pylist()])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), pa.array(ids, pa.binary())], names=["row", "doc_id", "part", "parts", "ids"])

    out = None
    left = stored(rows.where(~short).select("row", "doc_id", F.col("text").cast("binary").alias("bytes")), "long-texts")
    while left.take(1):
        met, left = _stitched(left, vocabulary, chunk, overlap)
        pieces = _encoded_pieces(met, vocabulary)
        out = pieces if out is None else out.unionByName(pieces)
        chunk, overlap = 2 * chunk, 2 * overlap
    return rows.where(short).mapInArrow(whole, PARTS), documents.sparkSession.createDataFrame([], PARTS) if out is None else out


def _stitched(texts: DataFrame, vocabulary: Vocabulary, length: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with their pre-tokens and the piece from_ to to_ of each, of texts whose chunks all meet; the other texts)."""
    schema = "row long, doc_id long, part int, parts int, start long, skip int, bytes binary, sizes array<int>, head array<long>, tail array<long>"
    parts = F.greatest(F.ceil((F.octet_length("bytes") - overlap) / F.lit(length)), F.lit(1)).cast("int")
    # texts are cut before the explode, so that no row carries more than its chunk
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("part"), F.substring("bytes", i * length + 1, F.lit(length + overlap)).alias("bytes")))
    chunks = texts.select("row", "doc_id", parts.alias("parts"), F.explode(cut).alias("c")).select("row", "doc_id", "c.part", "parts", "c.bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            for r in batch.to_pylist():
                made = chunk_boundaries(coder, r["bytes"], r["part"], length, overlap, r["part"] + 1 == r["parts"])
                yield arrays(schema, [(r["row"], r["doc_id"], r["part"], r["parts"], made[0], made[1], r["bytes"], *made[2:])])

    made = stored(chunks.mapInArrow(run, schema), "chunks")
    along = Window.partitionBy("row").orderBy("part")
    joints = made.select("row", "part", "parts", F.array_min(F.array_intersect("tail", F.lead("head").over(along))).alias("to_"))
    joints = joints.withColumn("from_", F.coalesce(F.lag("to_").over(along), F.lit(0).cast("long")))
    joints = stored(joints.withColumn("apart", F.max((F.col("to_").isNull() & (F.col("part") + 1 < F.col("parts"))).cast("int")).over(Window.partitionBy("row"))), "joints")
    met = made.drop("head", "tail").join(joints.where("apart = 0").select("row", "part", "from_", "to_"), ["row", "part"])
    return met, texts.join(joints.where("apart = 1").select("row").distinct(), "row", "left_semi")


def _encoded_pieces(met: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            for r in batch.to_pylist():
                ends = r["start"] + np.cumsum(r["sizes"], dtype=np.int64)
                starts = ends - np.array(r["sizes"], dtype=np.int64)
                at = np.flatnonzero((starts >= r["from_"]) & (True if r["to_"] is None else ends <= r["to_"]))
                text, base = memoryview(r["bytes"]), r["start"] - r["skip"]
                pre_tokens = [str(text[a:b], "utf-8") for a, b in zip((starts[at] - base).tolist(), (ends[at] - base).tolist(), strict=True)]
                yield arrays(PARTS, [(r["row"], r["doc_id"], r["part"], r["parts"], coder.encoded([pre_tokens])[0])])

    return met.mapInArrow(run, PARTS)


def decode(parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`parts` (see `encode`) with `bytes`, the raw bytes of the ids one after another; those of a text's parts make its bytes."""
    small_batches(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            out = [coder.decoded(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return parts.select("row", "doc_id", "part", "parts", "ids").mapInArrow(run, PARTS + ", bytes binary")


def digests(short: DataFrame, long_: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, from the tables of `encode`, decoded.

    Short texts are hashed where they are; the parts of long ones are brought together in order and hashed as they pass.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                ids.update(r["ids"])
                raw.update(r["bytes"])
                n += len(r["ids"]) // 4
                if r["part"] + 1 == r["parts"]:
                    done.append((r["doc_id"], n, ids.hexdigest(), raw.hexdigest()))
                    ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
            yield arrays(schema, done)

    one = short.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    return one.unionByName(long_.repartition("row").sortWithinPartitions("row", "part").mapInArrow(run, schema))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of `encode` and `decode` over all whole documents; see there for null, empty, long and repeated texts."""
    vocabulary = Vocabulary(spark)
    short, long_ = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return digests(decode(short, vocabulary), decode(long_, vocabulary))
