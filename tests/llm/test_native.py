"""Exact dedup, mixing and sharding: against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, name string, size string, place string"


def odd_documents(spark, more=()):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "hello world"), (4, "hello world"), (5, "hello  wor\tld"), (None, "helloworld"), (6, long), (7, long + "x"), (8, long.replace(" ", "  ")), (9, "é" * 5000), (10, "é" * 4999 + "e"), *more]
    rows = [(i, t, "en", ("s%d" % (k % 3)) if k % 5 else None, 0, "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for n, members in by.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))[0]
        out += [(i, keep, len(members), hashlib.sha256(n.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chars", "hasher"), [(4096, F.xxhash64), (64, F.xxhash64), (50, lambda b: F.pmod(F.xxhash64(b), F.lit(5)))])
def test_exact_groups(spark, chars, hasher):
    docs = odd_documents(spark, [(20 + i, "ab" * (i % 4) + "c" * 70 * (i % 3)) for i in range(24)])
    got = exact_dedup.exact_groups(docs, chars, hasher).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_empty_tables(spark):
    none = odd_documents(spark).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).columns == none.columns
    assert sharding.shuffle_shards(none).count() == 0


def test_exact_sql(spark):
    docs = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(exact_dedup.OP2_SQL.replace("FROM documents", f"FROM '{docs}'")).fetchall()
    got = exact_dedup.op2_exact_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 400}, {"a": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 9, "Z": 5, "é": 7}])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(k is None, k or "", v) for k, v in sizes.items()], "no_source boolean, source_name string, source_size long")
    got = {None if r["no_source"] else r["source_name"]: r["target"] for r in mixing.source_targets(s).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def brute_mix(rows, sizes, targets, seed, slices, hashed):
    """rows (doc_id, source, size): sorted (doc_id, source, size, copies) of a plain systematic sampler."""
    out = []
    for source in sizes:
        mine = [(size, i) for i, s, size in rows if s == source]
        bits = lambda n: len(f"{n:b}")
        of_class = lambda n: bits(n) * 8 + ((n >> bits(n) - 4) & 7 if bits(n) > 4 else n & 7)
        mine.sort(key=lambda r: (of_class(r[0]), hashed(seed, r[1], r[0]) % slices, r[0], hashed(seed, r[1], r[0]), r[1] is not None, r[1] or 0))
        each = targets[source] / sizes[source] if sizes[source] else 0.0
        offset = hashed(seed + 1, int(source is None), source or "") / 2**32
        for place, (size, i) in enumerate(mine):
            out.append((i, source, size, min(3, math.floor((place + 1) * each + offset) - math.floor(place * each + offset))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "slice_rows"), [(29, 8192), (7, 100)])
def test_mix(spark, seed, slice_rows):
    rng = random.Random(4)
    more = [(100 + i, " ".join("w" for _ in range(rng.randint(1, 60)))) for i in range(1500)]
    docs = odd_documents(spark, more)
    plan = mixing.plan_mix(docs, keep=["source"], seed=seed, slice_rows=slice_rows).collect()
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(7), keep=["source"], seed=seed, slice_rows=slice_rows).collect()))
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    hashed = lambda *parts: int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16)
    got = sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in plan), key=repr)
    assert got == brute_mix(rows, sizes, targets, seed, max(1, len(rows) // slice_rows), hashed)
    assert all(abs(r["target"] - targets[r["source"]]) < 1e-6 for r in plan)
    for s in sizes:
        taken = sum(n * c for _, x, n, c in got if x == s)
        assert abs(taken - targets[s]) <= max(n for _, x, n in rows if x == s)
    mixed = mixing.mix(docs, seed=seed)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.plan_mix(docs, seed=seed).collect())


def test_reruns_agree_without_ids(spark):
    """Documents of one size without ids, or with one id, are told apart by their texts."""
    docs = spark.createDataFrame([(None if i % 2 else 7, f"word{i} two three", "s%d" % (i % 3), i) for i in range(120)], "doc_id long, text string, source string, DOC_ID_ int")
    runs = [sorted(r["text"] for r in mixing.mix(docs.repartition(n), slice_rows=16).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 50
    cells = docs.select(mixing.uniform(F.lit(29), F.col("doc_id"), F.lit(3), F.md5(F.col("text").cast("binary"))).alias("u")).distinct().count()
    assert cells == 120


def test_sampling_is_unbiased(spark):
    """Over 1,000 even offsets every place of every worth is taken worth times on average, and only floor or ceiling times."""
    grid = spark.range(1000).select((F.col("id") / 1000.0).alias("offset")).crossJoin(spark.range(40).withColumnRenamed("id", "place")).crossJoin(spark.createDataFrame([(0.0,), (0.3,), (1.0,), (1.75,), (2.9,), (3.0,)], "each double"))
    rows = grid.groupBy("place", "each").agg(F.avg(mixing.copies_of(F.col("place"), F.col("each"), F.col("offset"))).alias("mean"), F.min(mixing.copies_of(F.col("place"), F.col("each"), F.col("offset"))).alias("low"), F.max(mixing.copies_of(F.col("place"), F.col("each"), F.col("offset"))).alias("high")).collect()
    assert len(rows) == 240 and all(abs(r["mean"] - r["each"]) < 0.0021 and r["low"] >= math.floor(r["each"]) and r["high"] <= math.ceil(r["each"]) for r in rows)


def test_mix_takes_every_document_sometimes(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    n = {i: 0 for i in range(60)}
    for seed in range(12):
        for r in mixing.plan_mix(docs, seed=seed).collect():
            n[r["doc_id"]] += r["copies"]
    by = [sum(n[i] for i in range(60) if i % 3 == k) / 12 / 20 for k in range(3)]
    assert min(n.values()) > 0 and by[0] > by[1] > by[2]


def test_mix_sql(spark):
    docs = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(mixing.OP3_SQL.replace("FROM documents", f"FROM '{docs}'")).fetchall()
    assert sorted(map(tuple, mixing.op3_mixing(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


@pytest.mark.parametrize(("population", "good", "draws"), [(30, 12, 9), (10, 10, 4), (8, 3, 8), (200, 100, 50)])
def test_hypergeometric(spark, population, good, draws):
    n = 20_000
    sql = sharding.hypergeometric_sql(f"{population}D", f"{good}D", f"{draws}D", "shiftrightunsigned(xxhash64(id, 5L), 11) / 9007199254740992D")
    got = {r["x"]: r["count"] for r in spark.range(n).selectExpr(f"{sql} AS x").groupBy("x").count().collect()}
    chi = 0.0
    for k in range(max(0, draws - (population - good)), min(good, draws) + 1):
        want = n * comb(good, k) * comb(population - good, draws - k) / comb(population, draws)
        if want >= 5:
            chi += (got.get(k, 0) - want) ** 2 / want
    assert set(got) <= set(range(max(0, draws - (population - good)), min(good, draws) + 1)) and chi < 60


def test_matrix_has_exact_margins(spark):
    sizes = spark.createDataFrame([(p, n) for p, n in enumerate([5, 0, 1000, 37, 1])], "part int, n long")
    rows = {r["part"]: r["ends"] for r in sharding.communication_matrix(sizes, 4).collect()}
    assert [rows[p][-1] for p in range(5)] == [5, 0, 1000, 37, 1]
    counts = [[b - a for a, b in zip([0, *rows[p]], rows[p], strict=False)] for p in range(5)]
    assert [sum(c[s] for c in counts) for s in range(4)] == [261, 261, 261, 260] and min(map(min, counts)) >= 0


def test_shards(spark):
    docs = odd_documents(spark, [(50 + i, f"text {i % 7}") for i in range(300)])
    got = sharding.shuffle_shards(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = sorted(map(len, by.values()))
    assert len(got) == docs.count() and sizes[-1] - sizes[0] <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shuffle_shards(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def chi_square(counts, cells):
    want = sum(counts.values()) / cells
    return sum((counts.get(c, 0) - want) ** 2 / want for c in range(cells))


@pytest.mark.parametrize("range_rows", [16384, 64])
def test_equal_rows_are_spread(spark, range_rows):
    """400 equal rows and 6,000 others: both fall evenly on (shard, quarter of its slots), and one in four or so of the equal rows' neighbours is equal by chance only."""
    docs = spark.range(6400).selectExpr("IF(id < 400, 1, id) AS doc_id", "IF(id < 400, 'same', concat('t', id)) AS text")
    got = sharding.shuffle_shards(docs, range_rows=range_rows).toPandas()
    per = len(got) // 8
    for rows in (got[got.doc_id == 1], got[got.doc_id != 1]):
        cells = (rows.shard * 4 + rows.slot * 4 // per).value_counts().to_dict()
        assert chi_square(cells, 32) < 62  # 31 degrees of freedom: beyond in 1 of 1,000 cases
    place = sorted((got[got.doc_id == 1].shard * per + got[got.doc_id == 1].slot).tolist())
    assert sum(b - a == 1 for a, b in zip(place, place[1:])) < 60  # 25 by chance


def test_places_are_uniform(spark):
    got = sharding.shuffle_shards(spark.range(16_000).selectExpr("id AS doc_id", "'x' AS text")).toPandas()
    cells = (got.doc_id // 1000 * 32 + got.shard * 4 + got.slot * 4 // 2000).value_counts().to_dict()
    assert chi_square(cells, 512) < 620  # 511 degrees of freedom
