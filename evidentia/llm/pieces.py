"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is the segmentation into vocabulary pieces of the greatest total score.  Positions between characters
are states; a piece from a to b is an arc of its score.  A text longer than `CHUNK` characters is split to chunks.
The state at a boundary is how many characters the piece that crosses it reaches beyond.  Each chunk yields a
matrix: entry (i, j) is the best score from state i at its start to state j at its end.  Matrices combine by the
max-plus product, which is associative; the scan gives each chunk the best scores at its start, with which each
chunk works out, by itself, from what state at its start any state at its end comes.  These maps combine by
composition, likewise associative, from the end of the text, where the state is known; then each chunk traces its pieces.

Texts of up to `GIANT` characters are scanned within a task, chunk by chunk.  Longer ones are dealt to tasks: Spark
combines `FANOUT` chunks a task, then those results, without ever holding a text as a whole.

Scores: the vocabulary is read from a SentencePiece model file given by its path; nothing is trained.  A model made for
pair merging has ranks for scores.  They become log probabilities by Zipf's law, ln p = -ln(rank + `ZIPF`) - ln(sum),
in whole units of 1 / `UNIT`, so that sums are exact in any order.  Of equal totals the segmentation counts whose last
piece is longest, then the one before it, and so on: ids don't depend on where chunks end.

Pieces never go from a character to a following space mark, so within a chunk the words between are independent,
and a worker remembers the best pieces of words it has met.  Characters that no piece has become UTF-8 byte pieces.
So does a literal U+2581, which stands for the space in pieces: every text decodes to itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, GIANT, FANOUT = 2048, 1 << 18, 64
SPACE = "▁"
#: Ranks count from this; log probabilities are whole multiples of 1 / UNIT.
ZIPF, UNIT = 2.7, 1 << 16
#: A byte piece costs as much as the worst piece and this much more, a byte.
UNKNOWN = 10.0
MEMO = 700_000
#: Units longer than this are not remembered.
LONG = 1024
#: Stands for a literal space mark of a text while its spaces are marks; decoding gives no such code point.
LITERAL = "\ud800"
NEVER = float("-inf")
_UNIT = re.compile(r" +[^ ]*")
#: Where a word ends and a space follows: no piece crosses such a place.
_CUT = re.compile(r"(?<=[^ ]) ")


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model, in order of id; types: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, object]]:
        while at < end:
            tag, at = number(at)
            kind = tag & 7
            if kind == 0:
                value, at = number(at)
            elif kind == 5:
                value, at = data[at : at + 4], at + 4
            elif kind == 1:
                value, at = data[at : at + 8], at + 8
            else:
                size, at = number(at)
                value, at = (at, at + size), at + size
            yield tag >> 3, value

    pieces = []
    for field, value in fields(0, len(data)):
        if field == 1:
            piece, score, kind = "", 0.0, 1
            for f, v in fields(*value):
                if f == 1:
                    piece = data[v[0] : v[1]].decode()
                elif f == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif f == 3:
                    kind = int(v)
            pieces.append((piece, score, kind))
    return pieces


@dataclass
class Vocabulary:
    ids: dict[str, tuple[int, float]]
    bytes_: list[int]
    #: what an id decodes to
    shown: list[bytes]
    #: every ending of a piece -> (ids, score) of the piece it is, or None
    ends: dict[str, tuple[tuple[int, ...], float] | None]
    #: score of each id; of a byte what it costs to need it
    costs: list[float]
    longest: int
    unknown: float

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.of(f.read())

    @classmethod
    def of(cls, data: bytes) -> Vocabulary:
        pieces = read_model(data)
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
            raise ValueError("pieces that reach over a space mark inside are not supported")
        ranked = sorted(normal, key=lambda x: (-x[2], x[0]))
        total = math.log(sum(1 / (r + ZIPF) for r in range(len(ranked))) or 1)
        ids = {p: (i, float(-round(UNIT * (math.log(r + ZIPF) + total)))) for r, (i, p, _) in enumerate(ranked)}
        by_id = {i: s for i, s in ids.values()}
        bytes_ = [0] * 256
        shown = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                bytes_[int(p[3:5], 16)] = i
                shown.append(bytes([int(p[3:5], 16)]))
            else:
                shown.append(p.replace(SPACE, " ").encode() if kind in (1, 4) else b"")
        ends: dict[str, tuple[tuple[int, ...], float] | None] = {p[n:]: None for p in ids for n in range(1, len(p))}
        whole = {p: ((i,), s) for p, (i, s) in ids.items()}
        unknown = min((s for _, s in ids.values()), default=0.0) - round(UNIT * UNKNOWN)
        costs = [by_id.get(i, unknown) for i in range(len(pieces))]
        return cls(ids, bytes_, shown, ends | whole, costs, max(map(len, ids), default=1), unknown)

    def arcs(self, text: str, entries: dict[int, float], end: int) -> Arcs:
        """Best scores of all places of a marked text, where paths may start at `entries` with the scores given there.

        Pieces begin before `end`, though they may reach beyond.
        """
        get, reach = self.ends.get, self.longest + 1
        score, origin, last = [NEVER] * (len(text) + 1), [-1] * (len(text) + 1), [()] * (len(text) + 1)
        first = min(entries)
        for b in range(first, len(text) + 1):
            best, at, piece = NEVER, -1, ()
            if b - 1 >= first and b <= end:
                at = b - 1
                found = get(text[at])
                if found:
                    piece, worth = found
                else:
                    raw = (SPACE if text[at] == LITERAL else text[at]).encode("utf-8", "surrogateescape")
                    piece, worth = tuple(self.bytes_[x] for x in raw), self.unknown * len(raw)
                best = score[at] + worth
            for a in range(b - 2, max(first - 1, b - reach), -1):
                found = get(text[a:b], 0)
                if found is None:
                    continue
                if not found:
                    break
                if a < end:
                    worth = score[a] + found[1]
                    if worth >= best and worth > NEVER:
                        best, at, piece = worth, a, found[0]
            given = entries.get(b, NEVER)
            if given > NEVER and given >= best:  # the piece from before is the longest
                best, at, piece = given, -1, ()
            score[b], origin[b], last[b] = best, at, piece
        return Arcs(score, origin, last)


@dataclass
class Arcs:
    score: list[float]
    origin: list[int]
    last: list[tuple[int, ...]]

    def back(self, at: int) -> tuple[int, list[int]]:
        """The place where the best path to `at` enters, and its ids from there."""
        found = []
        while self.origin[at] >= 0:
            found.append(self.last[at])
            at = self.origin[at]
        found.reverse()
        return at, list(chain.from_iterable(found))


def marked(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


class Words:
    """The pieces of units (spaces and the word after them), remembered in two generations.

    Units met for the first time are segmented in sorted order: scores up to the end of a common beginning are
    those of the unit before, so they are worked out once.  Each position keeps the piece that ends there and where
    it begins, so memory is linear in the unit's length; very long units are kept until the next are learnt.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.once: dict[str, tuple[int, ...]] = {}

    def learn(self, units_: set[str]) -> None:
        self.once = {}
        if len(self.young) + len(units_) > MEMO:
            self.old, self.young = self.young, {}
        new = units_ - self.young.keys()
        if self.old:
            known = new & self.old.keys()
            self.young.update((u, self.old[u]) for u in known)
            new -= known
        self._segment(sorted(new))

    def _segment(self, new: list[str]) -> None:
        v, young = self.vocabulary, self.young
        get, reach = v.ends.get, v.longest + 1
        score: list[float] = [0.0]
        origin: list[int] = [0]
        last: list[tuple[int, ...]] = [()]
        before = ""
        for unit in new:
            text = (unit[1:] if unit[:1] == LITERAL else " " + unit).replace(SPACE, LITERAL).replace(" ", SPACE)
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del score[same + 1 :], origin[same + 1 :], last[same + 1 :]
            for b in range(same + 1, len(text) + 1):
                at = b - 1
                found = get(text[at])
                if found:
                    piece, worth = found
                else:
                    raw = (SPACE if text[at] == LITERAL else text[at]).encode("utf-8", "surrogateescape")
                    piece, worth = tuple(v.bytes_[x] for x in raw), v.unknown * len(raw)
                best = score[at] + worth
                for a in range(b - 2, max(-1, b - reach), -1):
                    found = get(text[a:b], 0)
                    if found is None:
                        continue
                    if not found:
                        break
                    worth = score[a] + found[1]
                    if worth >= best:
                        best, at, piece = worth, a, found[0]
                score.append(best)
                origin.append(at)
                last.append(piece)
            at = len(text)
            back = []
            while at:
                back.append(last[at])
                at = origin[at]
            back.reverse()
            (young if len(unit) <= LONG else self.once)[unit] = tuple(chain.from_iterable(back))
            before = text

    def ids(self, units_: list[str]) -> list[int]:
        """The ids of units that have been learnt."""
        if self.once:
            return list(chain.from_iterable(self.once[u] if u in self.once else self.young[u] for u in units_))
        return list(chain.from_iterable(map(self.young.__getitem__, units_)))


#: One memory for each vocabulary in a worker, kept from task to task.
_WORDS: dict[str, Words] = {}


class Sent:
    """A model file read by the driver and sent to the tasks: no worker opens the path."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.key, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)  # the size of a vocabulary
        self.reach = Vocabulary.of(data).longest

    def words(self) -> Words:
        if self.key not in _WORDS:
            _WORDS[self.key] = Words(Vocabulary.of(self.data.value))
        return _WORDS[self.key]


def units(text: str) -> list[str]:
    """Parts of a text that no piece reaches over: runs of spaces with the word after them; a word before the first space.

    A word after a single space stands for both; any other part is marked by a first character that no text has.
    """
    if text[:1] == " " and "  " not in text:
        return text[1:].split(" ")
    first = text.find(" ")
    if first < 0:
        return [LITERAL + text] if text else []
    rest = [u[1:] if u[1:2] != " " else LITERAL + u for u in _UNIT.findall(text, first)]
    return [LITERAL + text[:first], *rest] if first else rest


def encode(text: str, words: Words, size: int = CHUNK) -> list[int]:
    """The ids of a text with the customary space before it."""
    return encode_all([text], words, size)[0]


def encode_all(texts: list[str], words: Words, size: int = CHUNK) -> list[list[int]]:
    """Short texts word by word; longer ones chunk by chunk through the scan.  Words are learnt together."""
    spaced = [" " + t for t in texts]
    cut = [[Chunk.of(t[a : a + size], t[a + size : a + size + words.vocabulary.longest - 1], a + size >= len(t)) for a in range(0, len(t), size)] if len(t) > size else None for t in spaced]
    us = [None if c else units(t) for c, t in zip(cut, spaced, strict=True)]
    words.learn(set(chain.from_iterable(u if u else chain.from_iterable(x.units for x in c or ()) for u, c in zip(us, cut, strict=True))))
    return [scanned(c, words) if c else words.ids(u) for u, c in zip(us, cut, strict=True)]


def decode(ids: list[int], vocabulary: Vocabulary) -> bytes:
    """The text of ids: pieces joined, space marks as spaces, less the first space.  Marks made of bytes stay."""
    text = b"".join(map(vocabulary.shown.__getitem__, ids))
    return text[1:] if text.startswith(b" ") else text


@dataclass
class Chunk:
    """A chunk cut where no piece crosses: `head` before the first such place, whole units, `tail` with what follows the chunk."""

    head: str
    units: list[str]
    tail: str
    inside: int  # characters of the tail that belong to the chunk
    ends: bool  # whether the text ends with it

    @classmethod
    def of(cls, chunk: str, ahead: str, ends: bool) -> Chunk:
        first = _CUT.search(chunk)
        if first is None:
            return cls("", [], chunk + ahead, len(chunk), ends)
        first = first.start()
        last = max(first, len(chunk[: chunk.rfind(" ") + 1].rstrip(" ")))
        return cls(chunk[:first], units(chunk[first:last]), chunk[last:] + ahead, len(chunk) - last, ends)

    @property
    def joined(self) -> bool:
        """Whether all paths meet inside, where the head ends."""
        return bool(self.head)

    def leaves(self, reach: int) -> range:
        """States at the end: how far a piece may reach beyond it."""
        if self.ends:
            return range(1)
        beyond = self.tail[self.inside :]
        # a piece may take more spaces, then letters, but no space after letters
        stop = _CUT.search(self.tail, self.inside)
        most = stop.start() - self.inside if stop else len(beyond)
        return range(max(min(most, len(beyond), reach - 1), 0) + 1)


def transfer(c: Chunk, words: Words) -> np.ndarray:
    """(i, j): best score from state i at a chunk's start to state j at its end."""
    v = words.vocabulary
    reach = v.longest
    out = np.full((reach, reach), NEVER)
    leaves = c.leaves(reach)
    if c.joined:
        head, tail = marked(c.head), v.arcs(marked(c.tail), {0: 0.0}, c.inside).score
        middle = sum(v.costs[i] for i in words.ids(c.units))
        for i in range(min(reach, len(head) + 1)):
            before = v.arcs(head, {i: 0.0}, len(head)).score[len(head)]
            for j in leaves:
                out[i, j] = before + middle + tail[c.inside + j]
        return out
    whole = marked(c.tail)
    for i in range(min(reach, len(whole) + 1)):
        score = v.arcs(whole, {i: 0.0}, c.inside).score
        for j in leaves:
            if i <= c.inside + j:
                out[i, j] = score[c.inside + j]
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def moved(prefix: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Best scores by state after a matrix, from those before it."""
    return (prefix[:, None] + m).max(0)


def traces(c: Chunk, prefix: np.ndarray, words: Words, only: int | None = None) -> dict[int, tuple[int, list[int]]]:
    """For each state at a chunk's end (or only one) the state at its start that the best path comes from, and the ids between.

    `prefix`: best scores by state at the start.
    """
    v = words.vocabulary
    entries = {i: s for i, s in enumerate(prefix.tolist()) if s > NEVER}
    leaves = c.leaves(v.longest) if only is None else [only]
    if c.joined:
        head = v.arcs(marked(c.head), {i: s for i, s in entries.items() if i <= len(c.head)}, len(c.head))
        state, ids = head.back(len(c.head))
        ids += words.ids(c.units)
        tail = v.arcs(marked(c.tail), {0: 0.0}, c.inside)
        return {j: (state, ids + tail.back(c.inside + j)[1]) for j in leaves}
    whole = v.arcs(marked(c.tail), entries, c.inside)
    return {j: whole.back(c.inside + j) for j in leaves if whole.score[c.inside + j] > NEVER}


START = 0  # the state at both ends of a text


def first_prefix(reach: int) -> np.ndarray:
    out = np.full(reach, NEVER)
    out[START] = 0.0
    return out


def scanned(cs: list[Chunk], words: Words) -> list[int]:
    """The ids of a text of several chunks: scores forward by matrices, states backward, then the pieces of each chunk."""
    prefixes = [first_prefix(words.vocabulary.longest)]
    for c in cs[:-1]:
        prefixes.append(moved(prefixes[-1], transfer(c, words)))
    state, parts = START, []
    for c, prefix in zip(reversed(cs), reversed(prefixes), strict=True):
        state, ids = traces(c, prefix, words, state)[state]
        parts.append(ids)
    return list(chain.from_iterable(reversed(parts)))


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def chunks(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """(rid, at, chunk, ahead, ends) of texts with the space before them; ahead: what a piece can reach into."""
    spaced = rows.select("rid", F.concat(F.lit(" "), "text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, raw in zip(batch.column("rid").to_pylist(), utf8(batch.column("text")), strict=True):
                text = raw.decode("utf-8", "surrogateescape")
                for a in range(0, len(text), size * 16):
                    starts = range(a, min(a + size * 16, len(text)), size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid] * len(starts), pa.int64()), pa.array([s // size for s in starts], pa.int32()), pa.array([_raw(text[s : s + size]) for s in starts], pa.binary()), pa.array([_raw(text[s + size : s + size + reach]) for s in starts], pa.binary()), pa.array([s + size >= len(text) for s in starts], pa.bool_())],
                        names=["rid", "at", "chunk", "ahead", "ends"],
                    )

    return spaced.mapInArrow(cut, "rid long, at int, chunk binary, ahead binary, ends boolean")


def _scanned(rows: DataFrame, sent: Sent, size: int) -> DataFrame:
    """`rid`, `at` and ids of the chunks of giant texts (rid, text)."""
    reach = sent.reach
    parts = stored(chunks(rows, size, reach - 1).repartition("rid", "at"), "chunks")

    def read(batch: pa.RecordBatch, words: Words) -> list[Chunk]:
        found = [Chunk.of(_text(c), _text(a), e) for c, a, e in zip(*(batch.column(n).to_pylist() for n in ("chunk", "ahead", "ends")), strict=True)]
        words.learn(set(chain.from_iterable(c.units for c in found)))
        return found

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.words()
        for batch in batches:
            found = [transfer(c, words).ravel() for c in read(batch, words)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("at"), pa.array(found, pa.list_(pa.float64()))], names=["rid", "at", "m"])

    each = stored(parts.select("rid", "at", "chunk", "ahead", "ends").mapInArrow(matrices, "rid long, at int, m array<double>").withColumn("block", (F.col("at") / FANOUT).cast("int")), "matrices")

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        total = None
        for m in pdf["m"]:
            m = np.asarray(m).reshape(reach, reach)
            total = m if total is None else product(total, m)
        return pd.DataFrame({"rid": [pdf["rid"].iloc[0]], "block": [pdf["block"].iloc[0]], "m": [total.ravel()]})

    blocks = each.groupBy("rid", "block").applyInPandas(combined, "rid long, block int, m array<double>")

    def prefixed(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        state = np.asarray(pdf["prefix"].iloc[0]) if "prefix" in pdf else first_prefix(reach)
        out = []
        for m in pdf["m"]:
            out.append(state)
            state = moved(state, np.asarray(m).reshape(reach, reach))
        return pd.DataFrame({"rid": pdf["rid"], key: pdf[key], "prefix": out})

    # one row for each FANOUT chunks of a text: a text of a billion characters has 8,000
    starts = blocks.groupBy("rid").applyInPandas(lambda p: prefixed(p, "block"), "rid long, block int, prefix array<double>")
    inner = each.join(starts, ["rid", "block"]).groupBy("rid", "block").applyInPandas(lambda p: prefixed(p, "at"), "rid long, at int, prefix array<double>")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.words()
        for batch in batches:
            rid, at, leave, enter, ids = [], [], [], [], []
            for c, p, r, k in zip(read(batch, words), *(batch.column(n).to_pylist() for n in ("prefix", "rid", "at")), strict=True):
                for j, (i, found) in traces(c, np.asarray(p), words).items():
                    for column, value in zip((rid, at, leave, enter, ids), (r, k, j, i, found), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), *(pa.array(x, pa.int32()) for x in (at, leave, enter)), pa.array(ids, pa.list_(pa.int32()))], names=["rid", "at", "leave", "enter", "ids"])

    ways = parts.join(inner, ["rid", "at"]).select("rid", "at", "chunk", "ahead", "ends", "prefix").mapInArrow(traced, "rid long, at int, leave int, enter int, ids array<int>")
    ways = stored(ways.withColumn("block", (F.col("at") / FANOUT).cast("int")), "ways")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The map of a whole block: state at its end -> state at its start."""
        total: dict[int, int] | None = None
        for _, chunk in sorted(pdf.groupby("at"), reverse=True):
            step = dict(zip(chunk["leave"].tolist(), chunk["enter"].tolist(), strict=True))
            total = step if total is None else {j: step[i] for j, i in total.items() if i in step}
        return pd.DataFrame({"rid": pdf["rid"].iloc[0], "block": pdf["block"].iloc[0], "leave": list(total), "enter": list(total.values())})

    def walked(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
        """From the end backwards: the state at the end of each block or chunk."""
        state = int(pdf["last"].iloc[0]) if "last" in pdf else START
        at, leave = [], []
        for k, rows_ in sorted(pdf.groupby(key), reverse=True):
            at.append(k)
            leave.append(state)
            state = int(rows_.loc[rows_["leave"] == state, "enter"].iloc[0])
        return pd.DataFrame({"rid": pdf["rid"].iloc[0], key: at, "last": leave})

    maps = ways.select("rid", "block", "at", "leave", "enter").groupBy("rid", "block").applyInPandas(composed, "rid long, block int, leave int, enter int")
    ends = maps.groupBy("rid").applyInPandas(lambda p: walked(p, "block"), "rid long, block int, last int")
    states = ways.select("rid", "block", "at", "leave", "enter").join(ends, ["rid", "block"]).groupBy("rid", "block").applyInPandas(lambda p: walked(p, "at"), "rid long, at int, last int")
    return ways.join(states.withColumnRenamed("last", "leave"), ["rid", "at", "leave"]).select("rid", "at", "ids")


def _rows(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    return documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _giants(rows: DataFrame, sent: Sent, giant: int, size: int) -> DataFrame | None:
    """doc_id, part and ids of the giant texts, None if there is none."""
    giants = stored(rows.where(F.length("text") > giant), "giants")
    if not giants.take(1):
        return None
    return _scanned(giants.select("rid", "text"), sent, size).join(giants.select("rid", "doc_id"), "rid").select("doc_id", F.col("at").alias("part"), "ids")


def tokenize(documents: DataFrame, path: str = MODEL, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id, part and ids (array<int>) of each row of `documents`; a giant text comes in parts numbered from 0.

    Null and empty texts have the one id of the space before them.  Repeated rows come out repeated, null ids too; an
    empty table gives no rows; columns other than doc_id and text are not read.  `path` is read by the driver alone.
    """
    rows = _rows(documents)
    sent = Sent(documents.sparkSession, path)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.words()
        for batch in batches:
            ids = encode_all([_text(t) for t in utf8(batch.column("text"))], words, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "part", "ids"])

    done = rows.where(F.length("text") <= giant).select("doc_id", "text").mapInArrow(short, "doc_id long, part int, ids array<int>")
    found = _giants(rows, sent, giant, size)
    return done if found is None else done.unionByName(found)


def detokenize(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, part, `text` (bytes) of encoded parts; only part 0 drops the space before the text."""
    sent = Sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.words().vocabulary
        for batch in batches:
            texts = [decode(ids, vocabulary) if part == 0 else decode([vocabulary.ids[SPACE][0], *ids], vocabulary) for ids, part in zip(batch.column("ids").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(texts, pa.binary())], names=["doc_id", "part", "text"])

    return encoded.select("doc_id", "part", "ids").mapInArrow(run, "doc_id long, part int, text binary")


DIGESTS = "doc_id long, part int, n_tokens long, ids_sha256 string, text_sha256 string"


def _digest_batch(doc_ids: pa.Array, parts: list[int], ids: list[list[int]], vocabulary: Vocabulary) -> pa.RecordBatch:
    space = vocabulary.ids[SPACE][0]
    texts = [decode(i, vocabulary) if p == 0 else decode([space, *i], vocabulary) for i, p in zip(ids, parts, strict=True)]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(parts, pa.int32()), pa.array(list(map(len, ids)), pa.int64()), pa.array([hashlib.sha256(array("i", i).tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
        names=["doc_id", "part", "n_tokens", "ids_sha256", "text_sha256"],
    )


def round_trip(documents: DataFrame, path: str = MODEL, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id, part, n_tokens, SHA-256 of the ids (native 32-bit) and of the bytes that they decode to, encoding and decoding in one pass."""
    rows = _rows(documents)
    sent = Sent(documents.sparkSession, path)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.words()
        for batch in batches:
            ids = encode_all([_text(t) for t in utf8(batch.column("text"))], words, size)
            yield _digest_batch(batch.column("doc_id"), [0] * len(ids), ids, words.vocabulary)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.words().vocabulary
        for batch in batches:
            yield _digest_batch(batch.column("doc_id"), batch.column("part").to_pylist(), batch.column("ids").to_pylist(), vocabulary)

    done = rows.where(F.length("text") <= giant).select("doc_id", "text").mapInArrow(short, DIGESTS)
    found = _giants(rows, sent, giant, size)
    return done if found is None else done.unionByName(found.mapInArrow(parts, DIGESTS))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token count, digest of the ids, digest of the text they decode to.

    Null and empty texts have one token; see `tokenize` for repeats, null ids and empty tables.
    """
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part, n_tokens and ids of every document, as `tokenize` gives them: see there for null, empty and very long texts.

    Rows that repeat an id are documents of their own; other columns are dropped; an empty table gives no rows.
    """
    return tokenize(docs).select("doc_id", "part", F.size("ids").cast("long").alias("n_tokens"), "ids")
