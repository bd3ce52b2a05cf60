"""Cutting lineage in iterative operators, in the folder that every executor sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint below ``spark.checkpoint.dir``, or below /tmp/checkpoints where that is unset and the master is local (tests)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", "")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: checkpoints need a folder that every executor sees")
        spark.sparkContext.setCheckpointDir(base or "/tmp/checkpoints")
    return df.checkpoint()


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its rows' places from 1 in that order, over all rows: a range-partitioned sort and the sizes of its partitions, so no task holds the whole table.  Ties get places one after another."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # one row a partition of the sort
    place = (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(out, place).drop("_at", "_part", "_start")


SMALL = 100_000  # rows that may be broadcast once they are counted


def ranked_within(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """df with its rows' places from 1 within their group: one sort over all rows by (group, order), cut into ranges, so a group may span any number of tasks.  Ties get places one after another."""
    by = [F.col(group), *order]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(runs.select("_group", "_of", "_first", before.alias("_before")))  # one row per group and range
    starts = F.broadcast(starts) if starts.count() <= SMALL else starts.hint("merge")  # by range and group: no key is large
    both = placed.join(starts, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(out, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_at", "_part", "_group", "_of", "_first", "_before")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 64, share: int = 1024) -> DataFrame:
    """left joined with right; a key that holds more than 1/share of left's rows is spread over ``salts`` tasks, its rows of right copied to each.

    The list of such keys has share - 1 rows at most and is broadcast; both tables are read twice, so they should be stored.
    """
    total = left.count()
    heavy = F.broadcast(left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * share > total).select(*keys, F.lit(True).alias("_heavy")))
    many = F.array(*[F.lit(i) for i in range(salts)])
    by = [c for c, kind in left.dtypes if "map<" not in kind]  # maps have no hash
    spread = left.join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop("_heavy")
    copied = right.join(heavy, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_heavy"), many).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")
