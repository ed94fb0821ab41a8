"""What the operators share: table access, shared scratch tables, Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r, as `bytes.split()` has them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that go to Python in one Arrow batch; texts can be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one of our own only where none is set and all runs on this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.evidentia.scratch", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="evidentia-")
            spark.conf.set("spark.evidentia.scratch", shared)
    return shared.rstrip("/")


def stored(df: DataFrame, what: str = "t") -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or `name` with as many `_` after it as no column of `df` has, upper and lower case taken alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold of one batch, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows a key from which on it is joined by itself, and the most such keys: what is broadcast has no more rows.
HOT_ROWS, HOT_KEYS = 10_000, 10_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """`left` joined to `right`, which has one row a key and in `n` how many rows of `left` have it.

    Frequent keys, `HOT_KEYS` of them at most, are joined by broadcast, so that none is dealt to one task; the
    others are shuffled.  Where no key is frequent nothing is broadcast: the rows are the same, the plan is a third.
    `right` is read up to four times: pass a stored table.  how: inner, left_semi or left_anti.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    line = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= line:
        return left.join(right, on, how)
    hot, cold = right.where(F.col(n) > line), right.where(F.col(n) <= line)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rest if how == "left_anti" else rest.unionByName(left.join(F.broadcast(hot), on, how))


def lots(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """`rows` with `lot`, so that any two rows of one key meet in some (key, lot) and none has many more than 2 x `most`.

    Keys of at most `most` rows have lot 0.  Larger ones are cut to parts by a hash of `by`, and a row goes to the
    lot of its own part with each other one.
    """
    large = stored(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
    if not large.take(1):
        return rows.withColumn("lot", F.lit(0).cast("long"))
    parts = F.ceil(F.col("n") / most)
    mine = F.pmod(F.xxhash64(by), parts)
    many = hot_join(rows, large, [key]).withColumns({"__parts": parts, "__mine": mine}).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    many = many.withColumn("lot", F.least("__mine", "__other") * F.col("__parts") + F.greatest("__mine", "__other"))
    return hot_join(rows, large, [key], how="left_anti").withColumn("lot", F.lit(0).cast("long")).unionByName(many.select(*rows.columns, "lot"))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id's decimal text leaves `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """The raw UTF-8 of a string column, null as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def chunked(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most `size` rows."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held
