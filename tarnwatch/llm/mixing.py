"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1 ... and share the words of the corpus; a source
gets at most ``max_repeat`` times its own words and the excess is shared again by weight among the others.  In closed form,
target = least(max_repeat * words, level * weight) with the one level at which the targets add up to all words.

Sampling: the documents of a source stand in a fixed order, small ones first, so that the words taken follow the copies
taken; every document is worth target / words of its source copies.  With the prefix sum of those and one random offset of the
source, a document is emitted once per integer that its stretch of the sum crosses: the expected copies of every document are exactly its worth, and
the words taken differ from the target by less than the longest document of the source.  The place in the order is the
count of all earlier (size class, slice) cells of the source plus the place in the cell.  A cell holds about ``slice_rows`` rows, and the counts are added up first within
a size class and then over the classes, so neither a source with a third of all rows nor its counts are one task.

Defined results: null or empty text has size 0 and takes 0 words; null source is a source of its own; a source without words gets target 0; a very long text counts
with all its words and is taken whole or not at all, 3 times at most; documents of one size stand in the order of a hash of doc_id, size and text, then doc_id;
repeated rows take part each for itself; an empty table gives an empty result; reruns agree, however the rows are dealt, as the order and the offsets depend on seed, doc_id,
source and text alone; other columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, table, write_table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources (no_source, source_name, source_size): one row per source, with ``target``.  One task orders the sources, never the documents."""
    rank = F.row_number().over(Window.orderBy("no_source", "source_name")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_name")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.first(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything)
    return s.withColumn("free", free).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("free"), F.lit(0.0)) * F.col("weight"))).select("no_source", "source_name", "source_size", "target")


def size_class(size: Column) -> Column:
    """A number that rises with size, eight to each doubling, by whole numbers only."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.when(bits > 4, F.floor(size / F.pow(F.lit(2.0), bits - 4)) % 8).otherwise(size % 8)).cast("int")


def uniform(*parts: Column) -> Column:
    """A whole number in [0, 2**32) that only depends on parts."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary")), F.lit(8)), 16, 10).cast("long")


def copies_of(place: Column, each: Column, offset: Column, max_repeat: int = MAX_REPEAT) -> Column:
    """How many integers lie in (place * each + offset, (place + 1) * each + offset]."""
    return F.least(F.floor((place + 1) * each + offset) - F.floor(place * each + offset), F.lit(max_repeat)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 29, slice_rows: int = 8192, keep: list[str] | None = None) -> DataFrame:
    """Copies of every row of docs (doc_id, text, source): the columns of keep and doc_id, size, source_size, target, copies."""
    keep = keep or []
    source = [F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_name")]
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))  # texts that share an id, or have none, get places of their own
    sized = docs.select("doc_id", *keep, *source, word_count(F.col("text")).alias("size"), digest.alias("digest"))
    sized = sized.withColumn("class", size_class(F.col("size"))).withColumn("u", uniform(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("digest"))).drop("digest")
    sized = write_table(sized, "op3-sized")
    slices = max(1, sized.count() // slice_rows)
    sized = sized.withColumn("slice", (F.col("u") % slices).cast("int"))
    name = ["no_source", "source_name"]
    cells = write_table(sized.groupBy(*name, "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "op3-cells")
    classes = write_table(cells.groupBy(*name, "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "op3-classes")
    targets = source_targets(classes.groupBy(*name).agg(F.sum("words").alias("source_size")), weights, max_repeat)
    earlier = lambda within, by: F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = classes.select(*name, "class", earlier(name, "class").alias("base")).join(targets, name)
    starts = cells.select(*name, "class", "slice", earlier([*name, "class"], "slice").alias("start")).join(bases, [*name, "class"])
    starts = starts.select(*name, "class", "slice", (F.col("base") + F.col("start")).alias("start"), "source_size", "target")
    place = F.col("start") + F.row_number().over(Window.partitionBy(*name, "class", "slice").orderBy("size", "u", "doc_id")) - 1
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform(F.lit(seed + 1), F.col("no_source").cast("int"), F.col("source_name")) / F.lit(float(1 << 32))
    ranked = sized.join(starts, [*name, "class", "slice"])
    return ranked.select("doc_id", *keep, "size", "source_size", "target", copies_of(place, each, offset, max_repeat).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the plan emits it; the columns stay as they are.

    Rows meet their plan by (doc_id, hash and length of the text); rows equal in those share their copies out evenly.
    """
    key = [F.xxhash64("text").alias("__tw_hash"), F.length("text").alias("__tw_len")]
    copies = plan_mix(docs.select("doc_id", "text", "source", *key), keep=["__tw_hash", "__tw_len"], **options)
    names = ["__tw_id", "__tw_hash", "__tw_len"]
    copies = copies.select(F.col("doc_id").alias("__p_id"), F.col("__tw_hash").alias("__p_hash"), F.col("__tw_len").alias("__p_len"), "copies").groupBy("__p_id", "__p_hash", "__p_len").agg(F.sum("copies").alias("__p_copies"), F.count("*").alias("__p_rows"))
    keyed = docs.withColumns(dict(zip(names, (F.col("doc_id"), *key), strict=True)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, ("__p_id", "__p_hash", "__p_len"), strict=True)]
    both = keyed.join(copies.where("__p_copies > 0").hint("merge"), same)  # the plan grows with the corpus: no broadcast
    nth = F.when(F.col("__p_rows") == 1, 1).otherwise(F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    own = F.floor(F.col("__p_copies") / F.col("__p_rows")) + F.when(nth <= F.col("__p_copies") % F.col("__p_rows"), 1).otherwise(0)
    return both.withColumn("__tw_own", own.cast("int")).where("__tw_own > 0").withColumn("__tw_copy", F.explode(F.array_repeat(F.lit(1), F.col("__tw_own")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_name,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), u AS (
  SELECT *, ('0x' || md5(concat_ws('|', '29', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR, digest))[1:8])::BIGINT AS u, length(bin(size)) AS bits FROM d
), c AS (
  SELECT *, bits * 8 + CASE WHEN bits > 4 THEN (size >> (bits - 4)) & 7 ELSE size & 7 END AS class, u % greatest(1, (SELECT count(*) FROM d) // 8192) AS slice FROM u
), s AS (
  SELECT no_source, source_name, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY no_source, source_name) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, no_source, source_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, first_value(CASE WHEN cap >= level * weight THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, no_source, source_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS free FROM l
), t AS (
  SELECT no_source, source_name, source_size, least(cap, coalesce(free, 0) * weight) AS target,
         ('0x' || md5(concat_ws('|', '30', no_source::INT::VARCHAR, source_name))[1:8])::BIGINT / 4294967296.0::DOUBLE AS off FROM f
), p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY no_source, source_name ORDER BY class, slice, size, u, doc_id NULLS FIRST) - 1 AS place
  FROM c JOIN t USING (no_source, source_name)
), e AS (
  SELECT *, least(floor((place + 1) * each + off) - floor(place * each + off), 3)::BIGINT AS copies FROM p
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""
