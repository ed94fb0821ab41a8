"""Tables of which a change rewrites only the buckets that it touches.

Parquet has no MERGE.  A bucketed table is parted by a hash of its key, and an update reads and overwrites the buckets of the changed
keys alone: what is written grows with the change, and the files of all other buckets keep their names.  Spark stages the
new files and puts them in place when the whole job has succeeded, so an update that dies leaves the old buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table unless it says otherwise.
BUCKETS = 64


@dataclass(frozen=True)
class Buckets:
    """A table at `path` with the columns of `schema` (DDL), parted by a hash of `key`, which is never null."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "piece_id"
    n: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def create(self, rows: DataFrame | None = None) -> Buckets:
        """Writes the table anew, with `rows` or empty."""
        self.replace(rows if rows is not None else self.spark.createDataFrame([], self.schema), list(range(self.n)))
        return self

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of `rows` lie in: `n` at most, whatever the rows."""
        return sorted(r.b for r in rows.where(F.col(self.key).isNotNull()).select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all; others are not listed or read."""
        table = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        table = table if buckets is None else table.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return table.where(F.col(self.key).isNotNull()).drop("bucket")

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """`rows` become the whole contents of `buckets`; rows of other buckets are an error of the caller's and would replace those too."""
        columns = [c.name for c in self.spark.createDataFrame([], self.schema).schema]
        # a row without a key in each bucket: one that loses all its rows is overwritten too
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        full = rows.select(*columns, self.bucket().alias("bucket")).unionByName(marks, allowMissingColumns=True)
        # rebalancing splits a bucket of very many rows over tasks and joins small ones
        full.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.path)

    def update(self, changes: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets that `changes` touch by what `fold` makes of their rows; gives the buckets."""
        buckets = self.touched(changes)
        if buckets:
            self.replace(fold(self.read(buckets)), buckets)
        return buckets
