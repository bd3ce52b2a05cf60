"""Shared helpers of the training-data operators.

Intermediate tables are written below the folder that the session names in
``spark.checkpoint.dir`` (every executor sees it), so a lost executor costs a
re-read and never the lineage.  ``/tmp/checkpoints`` is only taken where the
setting is absent and the master is local, as in tests; on a cluster without the setting an error says so.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"
#: The white space of the contracts, as a character class body: \x20 and \x09-\x0D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
_runs = threading.local()  # the open ``stored`` calls of a thread, each with the paths that were written for it


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a local one if unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that every executor sees")
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/tarnwatch/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the table read back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for paths in getattr(_runs, "open", [])[-1:]:
        paths.append(path)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnwatch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table of write_table that nothing reads any more."""
    path = getattr(df, "_tarnwatch_path", None)
    if path:
        _delete(df.sparkSession, path)


def stored(step: Callable[[], DataFrame], name: str) -> DataFrame:
    """What step returns, as a written table; all other tables that were written for it, in its own thread, are deleted.  Calls may be nested, and other threads' tables stay."""
    if not hasattr(_runs, "open"):
        _runs.open = []
    mine: list[str] = []
    _runs.open.append(mine)
    try:
        out = write_table(step(), name)
    finally:
        _runs.open.pop()
    for path in mine:
        if path != out._tarnwatch_path:
            _delete(out.sparkSession, path)
    for paths in _runs.open[-1:]:
        paths.append(out._tarnwatch_path)
    return out


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; call it once results are stored."""
    _delete(spark, shared_dir(spark))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left with the row of right for its keys.  right's keys are distinct, and weight says how many rows of left have them.

    The keys that hold more than 1/1024 of left's total rows, 1,023 at most, are looked up in place through a broadcast; all others meet in
    a merge join, where no key is large.  Both tables are read twice, so they should be written ones.
    """
    heavy = right.where(F.col(weight) * 1024 > total)
    light = right.where(F.col(weight) * 1024 <= total)
    hot = left.join(F.broadcast(heavy), keys)
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return hot.unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until no column of df (case aside) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def finite(vector: str) -> Column:
    """Whether the array is there and holds neither nulls nor non-finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that only depends on parts: 53 bits of their hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))
