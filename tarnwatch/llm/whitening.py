"""Embedding whitening through a tiled covariance: dimension pairs are tiles, and every tile is a sum over blocks of rows.

Entries become integers.  Rows are dealt into blocks, and each block is cut into strips of dimensions, its column blocks, which bring the sums per dimension.  A tile is a pair of strips (p, q), p <= q.
Column blocks are shuffled to (tile, block), centred by the integer next to the mean, and multiplied; the products are summed per tile, combined on the map side.  The tiles of one length of vectors are
assembled to the covariance, whose fraction of a unit in the centring is taken out in exact integers, and its eigenvectors are computed once, for all rows.  Every block is then projected on them.

A task holds one block (about ``block_values`` entries) or the tiles of one length; nothing but a few sums leaves a block, and sums are of integers, so the result does not depend on how rows are dealt.

Defined results: null vectors and those with null or non-finite entries are dropped; vectors of different lengths are whitened apart, each length with its own n; an empty vector has no component; entries
are held at +-2^31; a component whose variance is nothing next to the whole (under 1e-13 of the trace: constant entries, fewer rows than dimensions) has whitened and explained 0 and is left out of
identity_error (0 if none is left); deviation is null where it doesn't fit into 64 bits; null vec_ids and repeated rows are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, finite, table, write_table

SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 31
COLUMN_BLOCK = "dim int, block int, p int, rows int, data binary, sums array<long>, ids array<string>"
MODEL = "dim int, n long, sums array<long>, components array<array<double>>, scales array<double>, explained array<double>"
PROJECTED = "dim int, block int, n long, ids array<string>, deviations array<long>, whitened array<array<double>>, mean array<double>, spread array<double>"
NO_VARIANCE = 1e-13


def strip_width(dim: int, least: int = 32, most_strips: int = 8) -> int:
    return max(least, -(-dim // most_strips))


def integers(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) as (rid, vec_id, dim, x): the vectors that remain, entries as integers."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))) + SHIFT
    return vectors.where(finite("embedding") & (F.size("embedding") > 0)).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform("embedding", entry).alias("x"))


def column_blocks(rows: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """rows as column blocks: one row per block and strip of dimensions, entries row by row, with their sums; the first strip brings the ids."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(frame["dim"].iloc[0]), int(frame["block"].iloc[0])
        x, width = np.stack([np.asarray(v, dtype=np.int64) for v in frame["x"]]), strip_width(dim)
        parts = [np.ascontiguousarray(x[:, s : s + width]) for s in range(0, dim, width)]
        rows = [(dim, block, p, len(x), part.tobytes(), part.sum(axis=0).tolist(), frame["vec_id"].tolist() if p == 0 else None) for p, part in enumerate(parts)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMN_BLOCK.split(", ")])

    placed = rows.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("blocks")).cast("int"))
    return placed.select("dim", "block", F.col("vec_id").cast("string").alias("vec_id"), "x").groupBy("dim", "block").applyInPandas(cut, COLUMN_BLOCK)


def centres(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dim, p, block, sums, centre): the sums of each dimension of a strip over all rows, and the integers next to the means, for every block."""
    sums = blocks.select("dim", "p", F.posexplode("sums").alias("at", "s")).groupBy("dim", "p", "at").agg(F.sum("s").alias("s"))
    strips = sums.groupBy("dim", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("sums"))  # as many as the strip is wide
    sized = strips.join(sizes, "dim")
    return sized.select("dim", "p", "n", "sums", F.transform("sums", lambda s: F.round(s / F.col("n")).cast("long")).alias("centre"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def tile_product(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a block, the product of two of its centred column blocks (or of one with itself), row by row of the tile."""
    frame = frame.sort_values("own")
    y = [(np.frombuffer(r["data"], dtype=np.int64).reshape(r["rows"], -1) - np.asarray(r["centre"], dtype=np.int64)).astype(np.float64) for _, r in frame.iterrows()]
    product = y[0].T @ y[-1]  # doubles hold the sums exactly below 2^53
    dim, p, q = (int(frame[c].iloc[0]) for c in ("dim", "p", "q"))
    return pd.DataFrame({"dim": [dim], "p": [p], "q": [q], "product": [product.ravel()]})


def assemble(frame: pd.DataFrame, sums: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The covariance of one length from its tiles, and its first eigenvectors."""
    if not len(frame) or not len(sums):
        return pd.DataFrame(columns=[c.split()[0] for c in MODEL.split(", ")])
    dim, n = int(frame["dim"].iloc[0]), int(sums["n"].iloc[0])
    width, sums = strip_width(dim), sums.sort_values("p")
    total = [int(s) for part in sums["sums"] for s in part]
    centre = [int(m) for part in sums["centre"] for m in part]
    rest = np.array([s - n * m for s, m in zip(total, centre, strict=True)], dtype=np.float64)  # |rest| <= n / 2
    squares = np.zeros((dim, dim))
    for (p, q), part in frame.groupby(["p", "q"]):
        a, b = slice(p * width, min(dim, (p + 1) * width)), slice(q * width, min(dim, (q + 1) * width))
        values = np.zeros((a.stop - a.start) * (b.stop - b.start))
        values[part["at"].to_numpy()] = part["value"].to_numpy()
        squares[a, b] = values.reshape(a.stop - a.start, -1)
        squares[b, a] = squares[a, b].T
    v = (squares - np.outer(rest, rest) / n) / n
    e, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[: min(keep, dim)]
    trace, e, vectors = float(np.trace(v)), e[order], vectors[:, order]
    fine = e > NO_VARIANCE * trace if trace > 0 else np.zeros(len(e), dtype=bool)
    scales = np.where(fine, 1 / np.sqrt(np.where(fine, e, 1.0)), 0.0)
    explained = np.where(fine, e / trace if trace > 0 else 0.0, 0.0)
    return pd.DataFrame({"dim": [dim], "n": [n], "sums": [total], "components": [vectors.T.tolist()], "scales": [scales.tolist()], "explained": [explained.tolist()]})


def project(strips: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """A block's rows on the components, with what the block adds to the covariance of the result: its mean, and the products centred by it."""
    if not len(strips) or not len(model):
        return pd.DataFrame(columns=[c.split()[0] for c in PROJECTED.split(", ")])
    strips, m = strips.sort_values("p"), model.iloc[0]
    x = np.concatenate([np.frombuffer(d, dtype=np.int64).reshape(r, -1) for d, r in zip(strips["data"], strips["rows"], strict=True)], axis=1)
    n, total = int(m["n"]), [int(s) for s in m["sums"]]
    whole = [s // n for s in total]
    part = np.array([(s - n * w) / n for s, w in zip(total, whole, strict=True)])
    y = x - np.array(whole, dtype=np.int64)
    components = np.stack([np.asarray(c, dtype=np.float64) for c in m["components"]])
    w = (y - part) @ components.T * np.asarray(m["scales"])
    rest = np.array([s - n * c for s, c in zip(total, whole, strict=True)], dtype=np.int64)
    largest = int(np.abs(y).max()) * n + n
    if x.shape[1] * largest * largest < 1 << 63:
        deviations = ((n * y - rest) ** 2).sum(axis=1).tolist()
    else:  # beyond 64 bits on the way: Python's integers
        exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
        deviations = [d if d < 1 << 63 else None for d in exact]
    mean = w.mean(axis=0)
    spread = (w - mean).T @ (w - mean)
    ids = strips["ids"].iloc[0]
    row = {"dim": int(m["dim"]), "block": int(strips["block"].iloc[0]), "n": len(w), "ids": list(ids), "deviations": deviations, "whitened": w.tolist(), "mean": mean.tolist(), "spread": spread.ravel().tolist()}
    return pd.DataFrame([row])


def gaps_of(projected: DataFrame, keep: int) -> DataFrame:
    """(dim, gaps): what each entry of the covariance of the result lacks to the identity, from the blocks' own means and products."""
    pairs = [(i, j) for i in range(keep) for j in range(i, keep)]
    mean = lambda i: F.get("mean", F.lit(i))
    spread = lambda i, j: F.get("spread", F.lit(i) * F.size("mean") + j)
    means = [F.sum(F.col("n") * mean(i)).alias(f"m{i}") for i in range(keep)]
    sums = [F.sum(spread(i, j) + F.col("n") * mean(i) * mean(j)).alias(f"s{i}_{j}") for i, j in pairs]
    total = projected.groupBy("dim").agg(F.sum("n").alias("rows"), *means, *sums)
    covariance = lambda i, j: (F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") / F.col("rows")) / F.col("rows")
    gaps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.abs(covariance(i, j) - float(i == j)).alias("gap")) for i, j in pairs]
    return total.select("dim", F.array(*gaps).alias("gaps"))


def whiten(vectors: DataFrame, keep: int = 8, block_values: int = 1 << 20, seed: int = 89) -> DataFrame:
    """vectors (vec_id, embedding) as one row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = write_table(integers(vectors), "op12-rows")
    per_block = F.greatest(F.floor(F.lit(block_values) / F.col("dim")), F.lit(64))
    sizes = write_table(rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / per_block).cast("int")), "op12-sizes")
    blocks = write_table(column_blocks(rows, sizes, seed), "op12-blocks")
    centre = write_table(centres(blocks, sizes), "op12-centres")
    last = F.ceil(F.col("dim") / F.greatest(F.lit(32), F.ceil(F.col("dim") / 8))).cast("int") - 1
    other = blocks.select("dim", "block", F.col("p").alias("own"), "rows", "data").join(centre.select("dim", "block", F.col("p").alias("own"), "centre"), ["dim", "block", "own"])
    tiled = other.withColumn("with", F.explode(F.sequence(F.lit(0), last))).select("dim", "block", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "rows", "data", "centre")
    products = tiled.groupBy("dim", "block", "p", "q").applyInPandas(tile_product, "dim int, p int, q int, product array<double>")
    tiles = products.select("dim", "p", "q", F.posexplode("product").alias("at", "value")).groupBy("dim", "p", "q", "at").agg(F.sum("value").alias("value"))
    means = centre.where("block = 0").select("dim", "p", "n", "sums", "centre")
    model = write_table(tiles.groupBy("dim").cogroup(means.groupBy("dim")).applyInPandas(lambda t, s: assemble(t, s, keep), MODEL), "op12-model")
    sent = model.join(sizes.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["dim", "block"]
    projected = write_table(blocks.drop("sums").groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(project, PROJECTED), "op12-projected")
    varied = F.filter("gaps", lambda g: (F.get("scales", g["i"]) > 0) & (F.get("scales", g["j"]) > 0))
    worst = F.coalesce(F.array_max(F.transform(varied, lambda g: g["gap"])), F.lit(0.0))
    each = write_table(gaps_of(projected, keep).join(model, "dim").select("dim", F.col("n").alias("all"), "explained", worst.alias("identity_error")), "op12-each")
    listed = projected.select("dim", F.explode(F.arrays_zip("ids", "deviations", "whitened")).alias("r"))
    out = listed.join(each, "dim").select("r.*", "all", "identity_error", F.posexplode(F.arrays_zip(F.col("r.whitened").alias("w"), F.col("explained").alias("e"))).alias("at", "c"))
    out = out.select(F.col("ids").cast("long").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.col("all").alias("n"), F.col("deviations").alias("deviation"), F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), "identity_error")
    for done in (rows, sizes, blocks, centre, model):
        drop_table(done)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
