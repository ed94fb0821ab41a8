"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule is a host and a path.  It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's path.  The longest fitting rule decides.

Method: the rules' xxhash64 digests lie sorted in one file that Spark ships to every executor
(`addFile`); tasks memory-map it, so the workers of a machine share its pages.  For each URL all
(host suffix, path prefix) pairs that could be a rule are digested, a whole batch is probed with one
`searchsorted`, and each hit is confirmed on the stored string, so that a collision changes nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rule lists longer than this are refused: the array is sent to each machine.
MAX_RULES = 50_000_000
SEED = 0


class DigestArray:
    """Sorted digests with their strings: `digests.npy`, `offsets.npy` and `strings.bin` in one file set."""

    def __init__(self, digests: np.ndarray, offsets: np.ndarray, strings: np.ndarray, allow: np.ndarray, lengths: np.ndarray):
        self.digests, self.offsets, self.strings, self.allow, self.lengths = digests, offsets, strings, allow, lengths

    @staticmethod
    def write(rules: Iterable[tuple[str, str]], folder: str) -> list[str]:
        """`rules` are (verdict, host/path) pairs; of repeated strings the last counts.  Returns the paths written."""
        last = {text.encode(): verdict == "allow" for verdict, text in rules}
        if len(last) > MAX_RULES:
            raise ValueError(f"{len(last)} rules; at most {MAX_RULES} are sent to each machine")
        keys = sorted(last, key=lambda k: (xxhash.xxh64_intdigest(k, seed=SEED), k))
        tag = uuid.uuid4().hex
        parts = {
            "digests": np.array([xxhash.xxh64_intdigest(k, seed=SEED) for k in keys], dtype=np.uint64),
            "offsets": np.cumsum([0, *map(len, keys)]).astype(np.int64),
            "strings": np.frombuffer(b"".join(keys), dtype=np.uint8),
            "allow": np.array([last[k] for k in keys], dtype=np.bool_),
            "lengths": np.array(sorted({len(k) - k.index(b"/") for k in keys if b"/" in k}), dtype=np.int64),
        }
        paths = []
        for name, values in parts.items():
            paths.append(os.path.join(folder, f"{tag}-{name}.npy"))
            np.save(paths[-1], values)
        return paths

    @classmethod
    def open(cls, names: list[str]) -> DigestArray:
        return cls(*(np.load(SparkFiles.get(n), mmap_mode="r") if os.path.getsize(SparkFiles.get(n)) > 1 << 16 else np.load(SparkFiles.get(n)) for n in names))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The position of each key among the rules, -1 where it is none."""
        if not keys or not len(self.digests):
            return np.full(len(keys), -1, dtype=np.int64)
        probe = np.array([xxhash.xxh64_intdigest(k, seed=SEED) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, probe)
        inside = np.minimum(at, len(self.digests) - 1)
        out = np.full(len(keys), -1, dtype=np.int64)
        for i in np.flatnonzero(self.digests[inside] == probe):
            j = int(inside[i])
            while j < len(self.digests) and self.digests[j] == probe[i]:  # equal digests lie side by side
                if self.text(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def text(self, j: int) -> bytes:
        return self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes()


def candidates(host: bytes, path: bytes, lengths: np.ndarray) -> Iterator[bytes]:
    """All rule strings that would fit: each suffix of the host at a dot, each prefix of the path as long as some rule's."""
    prefixes = [path[:n] for n in lengths.tolist() if n <= len(path)]
    while host:
        for prefix in prefixes:
            yield host + prefix
        dot = host.find(b".")
        host = host[dot + 1 :] if dot >= 0 else b""


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds `host`, `path`, `rule` and `verdict` to `pages`.

    Null URLs and those without `://` have an empty host and path, fit no rule and get `default`.
    Columns of `pages` named like an added one are replaced.  Of two fitting rules the longer string
    wins, of equal ones that with the longer host.  Empty tables give empty results.
    """
    spark = pages.sparkSession
    paths = DigestArray.write(rules, tempfile.mkdtemp(prefix="rules-"))
    for p in paths:
        spark.sparkContext.addFile(p)
    names = [os.path.basename(p) for p in paths]
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)"), "#", 1)).otherwise("")
    after = F.substring_index(after, "?", 1)
    host = F.translate(F.substring_index(after, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.expr("substr(`__rest`, char_length(`host`) + 1)")
    split = pages.withColumn("__rest", after).withColumn("host", host).withColumn("path", path).drop("__rest")
    kept = [c for c in split.columns if c not in ("rule", "verdict")]
    split = split.select(*kept)
    fields = [*split.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", rule string, verdict string"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray.open(names)
        for batch in batches:
            hosts = [x.encode() for x in batch.column("host").to_pylist()]
            tails = [x.encode() for x in batch.column("path").to_pylist()]
            keys: list[bytes] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(hosts, tails, strict=True)):
                for key in candidates(h, p, index.lengths):
                    keys.append(key)
                    owner.append(i)
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            best = [(-1, -1)] * len(hosts)
            at = index.find(keys)
            for k in np.flatnonzero(at >= 0).tolist():
                i, text = owner[k], keys[k]
                size = (len(text), text.find(b"/"))
                if size > best[i]:
                    best[i], rule[i], verdict[i] = size, text.decode(), "allow" if index.allow[at[k]] else "block"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return split.mapInArrow(probe, schema)


#: The query's rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judge` of every page by the stated rules; see there for null and odd URLs and empty tables.

    Pages that repeat an id or a URL are judged row by row; of a very long URL all is read.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut
), rules(verdict, rule, r_host, r_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), hit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hit USING (page_id)
"""
