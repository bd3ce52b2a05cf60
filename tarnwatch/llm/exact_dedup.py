"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text without its white space is cut into blocks of ``block_chars`` code points.  The distinct blocks of the
corpus, in the order of (64-bit hash, block), are numbered 0, 1, 2 ...: the name of a block.  Then adjacent names
are paired, the distinct pairs are sorted and numbered in the same way, and so on until one name is left for each document.
Two documents have the same number of blocks and the same last name exactly if their normalised texts are equal: the hash only shortens what is sorted.
Different blocks that share a hash are told apart and named by their text; there, the blocks of a text are found again by its SHA-256 and place.

Rows move as (row, position, name); only the distinct blocks are shuffled as text, combined on the map side first.
Numbers come from a range-partitioned sort and the sizes of its partitions, so no key or bucket is one task.  Names that over 1/1024 of all rows share, 1,023 at
most, are looked up through a broadcast, all others by a merge join.  A level halves the names of a document, so the levels are log2 of the longest document's blocks.

Defined results: null text counts as empty and all empty texts are one group; a null doc_id sorts last among equally long
texts; repeated rows are separate members of a group (of fully tied rows one stays); very long texts are named whole, block by block; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, drop_table, lookup, table, write_table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def blocks_of(norm: Column, block_chars: int) -> Column:
    """Array of (hash, block), in order."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))


def numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys, which are distinct in order, as a written table with ``name``: how many come before in that order."""
    at = F.monotonically_increasing_id()  # partition and place in it
    sorted_keys = write_table(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "op2-sorted")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = sorted_keys.groupBy(part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))  # one row a partition of the sort
    return sorted_keys.withColumn("__part", F.shiftright("__at", 33)).join(starts, "__part").withColumn("name", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")


def name_documents(docs: DataFrame, block_chars: int = 4096, hasher=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Names of docs (doc_id, text).

    Returns two written tables: the rows (rid, doc_id, n_code_points, text_sha256, n_blocks) and the identities (rid, n_blocks, name).
    hasher only decides the sort order of blocks; tests pass one with collisions.
    """
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_code_points"), normalised(F.col("text")).alias("norm"))
    parts = norm.withColumn("blocks", blocks_of(F.col("norm"), block_chars))
    rows = write_table(
        parts.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_code_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.size("blocks").alias("n_blocks"), F.transform("blocks", lambda b: hasher(b)).alias("hashes"),
        ),
        "op2-rows",
    )
    one = parts.select(F.explode("blocks").alias("block")).select(hasher(F.col("block")).alias("h"), "block")
    distinct = one.groupBy("h", "block").agg(F.count("*").alias("rows"))
    hashes = write_table(distinct.groupBy("h").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows")), "op2-hashes")
    n_texts, n_rows = hashes.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    n_hashes = hashes.count()
    placed = lookup(rows.select("rid", "n_blocks", F.posexplode("hashes").alias("pos", "h")), numbered(hashes, ["h"]), ["h"], "rows", n_rows)
    if n_texts > n_hashes:
        # blocks with one hash but different text are named by their text, after all others
        shared = hashes.where("texts > 1").select("h")
        texts = one.join(shared, "h", "left_semi").distinct()
        names = numbered(texts, ["h", "block"]).select("h", "block", (F.col("name") + n_hashes).alias("own"))
        again = parts.select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode("blocks").alias("pos", "block")).select("text_sha256", "pos", "block", hasher(F.col("block")).alias("h"))
        found = again.join(shared, "h", "left_semi").distinct().join(names, ["h", "block"]).select("text_sha256", "pos", "own")
        placed = placed.join(rows.select("rid", "text_sha256"), "rid").join(found, ["text_sha256", "pos"], "left").withColumn("name", F.coalesce("own", "name"))
    level = write_table(placed.select("rid", "n_blocks", F.col("pos").cast("long").alias("pos"), F.col("name").cast("long").alias("name")), "op2-level0")
    done = [rows.where("n_blocks = 0").select("rid", "n_blocks", F.lit(-1).cast("long").alias("name")), level.where("n_blocks = 1").select("rid", "n_blocks", "name")]
    longest = rows.agg(F.max("n_blocks")).first()[0] or 0
    width, step = level.where("n_blocks > 1"), 1
    while step < longest:
        pairs = width.groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = write_table(pairs, "op2-pairs")
        kinds = numbered(pairs.groupBy("l", "r").agg(F.count("*").alias("rows")), ["l", "r"])
        level = write_table(lookup(pairs, kinds, ["l", "r"], "rows", pairs.count()).select("rid", "n_blocks", "pos", F.col("name").cast("long").alias("name")), "op2-level")
        drop_table(pairs)
        step *= 2
        done.append(level.where(F.col("n_blocks") <= step).select("rid", "n_blocks", "name"))
        width = level.where(F.col("n_blocks") > step)
    identities = done[0]
    for d in done[1:]:
        identities = identities.unionByName(d)
    return rows.drop("hashes"), write_table(identities, "op2-identities")


def exact_groups(docs: DataFrame, block_chars: int = 4096, hasher=F.xxhash64) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows, identities = name_documents(docs, block_chars, hasher)
    all_rows = write_table(rows.drop("n_blocks").join(identities, "rid"), "op2-named")
    best = F.min(F.struct((-F.col("n_code_points")).alias("c"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
    groups = write_table(all_rows.groupBy("n_blocks", "name").agg(best.alias("keep"), F.count("*").alias("group_size")), "op2-groups")
    both = lookup(all_rows, groups, ["n_blocks", "name"], "group_size", all_rows.count())
    return both.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
  FROM d WINDOW w AS (PARTITION BY n ORDER BY c DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(n) AS text_sha256 FROM g
"""
