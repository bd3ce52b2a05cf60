"""A uniform shuffle into shards of exact sizes through a hypergeometric communication matrix, in DataFrame operations only.

The rows lie in ``parts`` parts.  How many rows of each part go to each shard is drawn first, exactly as a uniform permutation of all rows
would deal them: one hypergeometric draw after the other, by inversion from the mode.  The draws go in two steps, first for groups of
parts and then, one task a group, for the parts of each.  Then each part is permuted by a random key and cut at those counts, the pieces are exchanged,
and each shard is permuted by a second key.  The law is ``rows``: shard sizes differ by one at most.

A row's random keys are hashes of the seed and of the row's own number, so equal rows are shuffled apart like any others.  The matrix has parts x shards
numbers whatever the input; ranks inside a part or shard are counted by ranges of the random key, of about ``range_rows`` rows each, so neither a part nor a shard is one task.

Defined results: null text has size 1 and the crc32 of nothing (0), like empty text; rows with null doc_id, repeated rows, equal and very long texts are shuffled like any
other row; an empty table gives an empty result; the result depends on seed and on the place of a row in the input (same files, same settings: same result); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, table, write_table

SHARDS = 8


def hypergeometric_sql(population: str, good: str, draws: str, u: str) -> str:
    """SQL of one draw: how many of ``draws`` balls are good, of ``population`` with ``good`` good ones; u in [0, 1).

    The probabilities relative to that of the mode are summed outward from it until 12 standard deviations and 60 more,
    beyond which less is left than a double can tell from 0.
    """
    up = "(({K}-(md+t-1D))*({n}-(md+t-1D)))/((md+t)*({M}-{K}-{n}+md+t))"
    down = "((md-t+1D)*({M}-{K}-{n}+md-t+1D))/(({K}-(md-t))*({n}-(md-t)))"
    pu = f"IF(md+t<=hi, a.pu*{up}, 0D)"
    pd = f"IF(md-t>=lo, a.pd*{down}, 0D)"
    total = f"aggregate(sequence(1, w), named_struct('pu',1D,'pd',1D,'s',1D), (a,t) -> named_struct('pu',{pu},'pd',{pd},'s',a.s+{pu}+{pd}), a -> a.s)"
    pick = (
        f"aggregate(sequence(1, w), named_struct('pu',1D,'pd',1D,'r',{{u}}*tot-1D,'x',IF({{u}}*tot<1D, md, -1D)), (a,t) -> named_struct('pu',{pu},'pd',{pd},'r',a.r-{pu}-{pd},"
        f"'x',CASE WHEN a.x>=0D THEN a.x WHEN a.r<{pu} THEN md+t WHEN a.r<{pu}+{pd} THEN md-t ELSE -1D END), a -> IF(a.x<0D, md, a.x))"
    )
    # transform over one-element arrays binds the names lo, hi, md, w and tot once each
    body = f"transform(array({total}), tot -> {pick})[0]"
    body = f"transform(array(CAST(least(hi-lo, 12D*sqrt(greatest({{n}}*({{K}}/{{M}})*(1D-{{K}}/{{M}})*({{M}}-{{n}})/greatest({{M}}-1D,1D),0D))+60D) AS INT)), w0 -> transform(array(greatest(w0,1)), w -> {body})[0])[0]"
    body = f"transform(array(least(hi, greatest(lo, floor(({{n}}+1D)*({{K}}+1D)/({{M}}+2D))))), md0 -> transform(array(CAST(md0 AS DOUBLE)), md -> {body})[0])[0]"
    body = f"transform(array(named_struct('lo',greatest(0D,{{n}}-({{M}}-{{K}})),'hi',least({{n}},{{K}}))), b -> {body.replace('hi-lo', 'b.hi-b.lo').replace('<=hi', '<=b.hi').replace('>=lo', '>=b.lo').replace('least(hi, greatest(lo,', 'least(b.hi, greatest(b.lo,')})[0]"
    for key, value in (("{M}", population), ("{K}", good), ("{n}", draws), ("{u}", u)):
        body = body.replace(key, f"({value})")
    return f"CAST(IF(({draws})<=0D OR ({good})<=0D, 0D, IF(({good})>=({population}), ({draws}), {body})) AS BIGINT)"


def deal(lists: DataFrame, shards: int, seed: int) -> DataFrame:
    """lists (parts: array of (part, n), rem: rows that each shard still takes, as many as the parts hold) as (part, counts): one draw per part and shard."""
    u = f"(shiftrightunsigned(xxhash64(p.part, s, {seed}L), 11) / {float(1 << 53)}D)"
    draw = hypergeometric_sql("CAST(i.pop AS DOUBLE)", "CAST(o.rem[s] AS DOUBLE)", "CAST(i.left AS DOUBLE)", u)
    one = (
        f"aggregate(sequence(0, {shards - 1}), named_struct('left', p.n, 'pop', aggregate(o.rem, 0L, (x,y) -> x+y), 'row', CAST(array() AS ARRAY<BIGINT>)),"
        f" (i,s) -> transform(array({draw}), x -> named_struct('left', i.left-x, 'pop', i.pop-o.rem[s], 'row', array_append(i.row, x)))[0], i -> i.row)"
    )
    start = "named_struct('rem', rem, 'all', CAST(array() AS ARRAY<ARRAY<BIGINT>>))"
    fold = f"aggregate(parts, {start}, (o,p) -> transform(array({one}), r -> named_struct('rem', zip_with(o.rem, r, (x,y) -> x-y), 'all', array_append(o.all, r)))[0], o -> o.all)"
    return lists.selectExpr("parts", f"{fold} AS counts").selectExpr("inline(arrays_zip(parts, counts))").selectExpr("parts.part AS part", "counts")


def communication_matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = 41, group_parts: int = 8) -> DataFrame:
    """sizes (part, n): bounded.  Returns (part, ends): for each part the cumulated counts of its rows for shards 0, 1 ..."""
    listed = lambda key: F.array_sort(F.collect_list(F.struct(F.col(key).alias("part"), F.col("n").cast("long").alias("n")))).alias("parts")
    groups = sizes.withColumn("of", F.floor(F.col("part") / group_parts).cast("int")).groupBy("of").agg(listed("part"), F.sum("n").cast("long").alias("n"))
    total = groups.agg(listed("of"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))
    shares = f"transform(sequence(0, {shards - 1}), s -> total DIV {shards} + IF(s < total % {shards}, 1L, 0L)) AS rem"
    drawn = deal(total.selectExpr("parts", shares), shards, seed + 3).withColumnsRenamed({"part": "of", "counts": "rem"})
    rows = deal(groups.select("of", "parts").join(drawn.hint("merge"), "of").repartition("of"), shards, seed)
    return rows.selectExpr("part", "transform(sequence(1, size(counts)), k -> aggregate(slice(counts, 1, k), 0L, (x,y) -> x+y)) AS ends")


def ranked(df: DataFrame, group: str, key: str, ranges: int, out: str) -> DataFrame:
    """df with ``out``: its row's place (from 0) among the rows of the group in the order of key, a 64-bit hash, and rid.
    A group is cut into ``ranges`` (a power of two) ranges of key; their counts are joined on the keys that the rows are dealt by already."""
    bits = ranges.bit_length() - 1
    df = df.withColumn("__range", F.shiftright(F.col(key), 64 - bits) if bits else F.lit(0).cast("long"))
    cells = df.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select(group, "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(group, "__range").orderBy(key, "rid"))
    return df.withColumn("__nth", nth).join(starts, [group, "__range"]).withColumn(out, F.col("__start") + F.col("__nth") - 1).drop("__range", "__start", "__nth")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, parts: int = 64, range_rows: int = 16384, seed: int = 41) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("rid"))
    rows = write_table(rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(parts)).cast("int")), "op7-rows")
    sizes = write_table(rows.groupBy("part").agg(F.count("*").alias("n")), "op7-sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = lambda groups: 1 << max(0, -(-n // (groups * range_rows)) - 1).bit_length()
    matrix = write_table(communication_matrix(sizes, shards, seed), "op7-matrix")
    dealt = ranked(rows.withColumn("k1", F.xxhash64("rid", F.lit(seed + 1))), "part", "k1", ranges(parts), "at").join(F.broadcast(matrix), "part")  # one row per part
    shard = F.size(F.filter("ends", lambda e: e <= F.col("at"))).cast("int").alias("shard")
    dealt = write_table(dealt.select("doc_id", "size", "text_crc32", "rid", shard), "op7-dealt")
    drop_table(rows)
    drop_table(sizes)
    placed = ranked(dealt.withColumn("k2", F.xxhash64("rid", F.lit(seed + 2))), "shard", "k2", ranges(shards), "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
