"""Hard negatives by a block matrix multiply in two dimensions: integer scores of anchors against all rows, tile by tile.

Anchors and rows are dealt into blocks, and blocks are cut into chunks of dimensions.  A tile (i, j) is anchor block i against row block j.  For every chunk, both blocks are sent to the tile
and multiplied: a partial tile of integer scores.  The partial tiles of all chunks are shuffled to their tile and added in 64 bits.  Each tile gives its best positives per anchor;
the best over all tiles fix a window of scores per anchor and positive, and each tile gives its best rows in every window, whose best over all tiles are the result.

A task holds one tile (``anchor_rows`` x ``block_rows`` scores) and the partial tiles of at most 16 chunks, whatever the input.  Anchors are a stated query set and are compared with all rows, so the work is
their number times that of the rows, spread over the tiles evenly: no key decides where a row goes.  Tiles travel in the narrowest integers that hold their scores.

Defined results: rows with a null label, a null vector, null or non-finite components take no part; vectors of different lengths are not compared; empty vectors score 0 with each other; a null vec_id
is never an anchor and comes last among equal scores; a component is held at +-sqrt(2^62 / length), so that scores fit into 64 bits (unit vectors are far below); repeated rows are rows of their own (each is the
other's positive); an anchor without positives, or with none in the window, gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, finite, table, write_table

SCALE = 256
ROW = "dim int, block int, k int, width int, kind string, data binary, rid binary, id binary, no_id binary, label binary"


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the narrowest integers that hold it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in 64 bits; in doubles where those hold every sum."""
    most = [int(np.abs(m.astype(np.int64)).max()) if m.size else 0 for m in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, the first ones among equals, highest first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]
    return at[np.lexsort((at, -scores[at]))]


def in_window(scores: np.ndarray, low: int, high: int, k: int) -> slice:
    """Of scores in falling order, the first k from high down to low."""
    first, last = np.searchsorted(-scores, -high, "left"), np.searchsorted(-scores, -low, "right")
    return slice(int(first), int(min(last, first + k)))


def quantized(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) as (rid, vec_id, label, dim, x): the rows that take part, with integer components."""
    limit = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("embedding"), F.lit(1)))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)))
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(moved, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return vectors.where(F.col("label").isNotNull() & finite("embedding")).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.size("embedding").alias("dim"), whole.alias("x"))


def blocks_of(rows: DataFrame, count: str, chunk_dims: int, seed: int) -> DataFrame:
    """rows, joined with their table of sizes, as blocks: one row per block and chunk of dimensions; the first chunk brings the rows' ids and labels."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(no_id=frame["vec_id"].isna()).sort_values(["no_id", "vec_id", "rid"])
        dim, block = int(frame["dim"].iloc[0]), int(frame["block"].iloc[0])
        x = np.stack([np.asarray(v, dtype=np.int64) for v in frame["x"]]).reshape(len(frame), dim)
        width = max(chunk_dims, -(-dim // 16))
        meta = [frame["rid"].to_numpy(np.int64), frame["vec_id"].fillna(0).to_numpy(np.int64), frame["no_id"].to_numpy(np.bool_), frame["label"].to_numpy(np.int64)]
        out = []
        for k, start in enumerate(range(0, max(1, dim), width)):
            part = narrow(np.ascontiguousarray(x[:, start : start + width]))
            out.append((dim, block, k, part.shape[1], part.dtype.name, part.tobytes(), *(m.tobytes() if k == 0 else None for m in meta)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(count)).cast("int"))
    # ids travel as text where one may be null, so that no 64-bit id passes through a double
    return placed.select("dim", "block", "rid", F.col("vec_id").cast("string").alias("vec_id"), "label", "x").groupBy("dim", "block").applyInPandas(lambda f: build(f.assign(vec_id=f["vec_id"].astype("Int64"))), ROW)


def matrix(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=row["kind"]).reshape(-1, row["width"]) if row["width"] else np.zeros((len(row["rid"]) // 8, 0), dtype=np.int8)


def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """One chunk of an anchor block against the same chunk of a row block: a partial tile."""
    if not len(a) or not len(b):
        return pd.DataFrame(columns=["dim", "i", "j", "kind", "data", *META])
    a, b = a.iloc[0], b.iloc[0]
    part = narrow(product(matrix(a), matrix(b)))
    return pd.DataFrame([(a["dim"], a["i"], a["j"], part.dtype.name, part.tobytes(), *(side[c] for side in (a, b) for c in ("rid", "id", "no_id", "label")))], columns=["dim", "i", "j", "kind", "data", *META])


META = [f"{side}_{c}" for side in ("a", "b") for c in ("rid", "id", "no_id", "label")]
FOUND = "dim int, i int, at int, place int, anchor_id long, positive_id long, positive_score long, id long, score long"
TILE = "dim int, i int, j int, kind string, data binary, " + ", ".join(f"{c} binary" for c in META)


def add(frame: pd.DataFrame, positives: int) -> pd.DataFrame:
    """The sum of a tile's partial tiles, and its best positives of every anchor."""
    first = frame[frame["a_rid"].notna()].iloc[0]
    meta = {c: np.frombuffer(first[c], dtype=np.bool_ if c.endswith("no_id") else np.int64) for c in META}
    shape = (len(meta["a_rid"]), len(meta["b_rid"]))
    total = np.zeros(shape, dtype=np.int64)
    for kind, data in zip(frame["kind"], frame["data"], strict=True):
        total += np.frombuffer(data, dtype=kind).reshape(shape)
    found = []
    for at in range(shape[0]):
        same = np.flatnonzero((meta["b_label"] == meta["a_label"][at]) & (meta["b_rid"] != meta["a_rid"][at]))
        for p in same[best(total[at, same], positives)]:
            found.append({"at": at, "anchor": int(meta["a_id"][at]), "id": None if meta["b_no_id"][p] else int(meta["b_id"][p]), "score": int(total[at, p])})
    total = narrow(total)
    row = {c: first[c] for c in ("dim", "i", "j", *META)} | {"kind": total.dtype.name, "data": total.tobytes(), "best": found}
    return pd.DataFrame([row])


def negatives_of(tile: pd.DataFrame, windows: pd.DataFrame, per_positive: int, low: int, high: int) -> pd.DataFrame:
    """A tile's first rows of another label in every window: low to high percent of the positive's score."""
    columns = [c.split()[0] for c in FOUND.split(", ")]
    out = []
    if len(tile) and len(windows):
        tile = tile.iloc[0]
        rid, label, ids, no_id = (np.frombuffer(tile[c], dtype=np.bool_ if c.endswith("no_id") else np.int64) for c in ("b_rid", "b_label", "b_id", "b_no_id"))
        own = np.frombuffer(tile["a_label"], dtype=np.int64)
        scores = np.frombuffer(tile["data"], dtype=tile["kind"]).reshape(len(own), len(rid))
        by_anchor: dict[int, list] = {}
        for w in windows["windows"].iloc[0]:
            by_anchor.setdefault(w["at"], []).append(w)
        for at, mine in by_anchor.items():
            other = np.flatnonzero(label != own[at])
            s = scores[at, other].astype(np.int64)
            order = np.argsort(-s, kind="stable")
            s, other = s[order], other[order]
            for w in mine:
                score = int(w["score"])
                for n in range(*in_window(s, -(-low * score // 100), high * score // 100, per_positive).indices(len(s))):
                    out.append((tile["dim"], tile["i"], at, w["place"], w["anchor"], w["id"], score, None if no_id[other[n]] else int(ids[other[n]]), int(s[n])))
    return pd.DataFrame(out, columns=columns).astype({"positive_id": "Int64", "id": "Int64"})


def mine(vectors: DataFrame, positives: int = 5, per_positive: int = 10, low: int = 30, high: int = 90, anchor_every: int = 100, chunk_dims: int = 32, anchor_rows: int = 256, block_rows: int = 2048, seed: int = 83) -> DataFrame:
    """Per anchor (vec_id divisible by anchor_every) and positive, the first rows of another label whose score is low to high percent of the positive's.

    vectors (vec_id, embedding, label); returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = write_table(quantized(vectors), "op11-rows")
    anchor = F.coalesce(F.col("vec_id") % anchor_every == 0, F.lit(False))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors")).where("anchors > 0")
    sizes = write_table(counts.select("dim", F.ceil(F.col("n") / block_rows).cast("int").alias("js"), F.ceil(F.col("anchors") / anchor_rows).cast("int").alias("is")), "op11-sizes")
    sized = rows.join(sizes, "dim")
    left = write_table(blocks_of(sized.where(anchor), "is", chunk_dims, seed), "op11-anchors")
    right = write_table(blocks_of(sized, "js", chunk_dims, seed + 1), "op11-blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, "dim").withColumnRenamed("block", "i").withColumn("j", upto("js")).drop("is", "js")
    b = right.join(sizes, "dim").withColumnRenamed("block", "j").withColumn("i", upto("is")).drop("is", "js")
    key = ["dim", "i", "j", "k"]
    partial = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(multiply, TILE)
    tiles = write_table(partial.groupBy("dim", "i", "j").applyInPandas(lambda f: add(f, positives), f"{TILE}, best array<struct<at:int,anchor:long,id:long,score:long>>"), "op11-tiles")
    first = lambda by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    chosen = tiles.select("dim", "i", F.inline("best")).withColumn("place", F.row_number().over(first(["dim", "i", "at"]))).where(F.col("place") <= positives)
    # one row per anchor block: anchor_rows x positives windows at most
    windows = write_table(chosen.groupBy("dim", "i").agg(F.collect_list(F.struct("at", "place", "anchor", "id", "score")).alias("windows")), "op11-windows")
    sent = windows.join(sizes, "dim").withColumn("j", upto("js")).select("dim", "i", "j", "windows")
    key = ["dim", "i", "j"]
    found = tiles.drop("best").groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(lambda t, w: negatives_of(t, w, per_positive, low, high), FOUND)
    ranks = found.withColumn("rank", F.row_number().over(first(["dim", "i", "at", "place"]))).where(F.col("rank") <= per_positive)
    out = write_table(ranks.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "op11-out")
    for done in (rows, sizes, left, right, tiles, windows):
        drop_table(done)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, place ORDER BY s.score DESC, s.id) AS nth
      FROM p JOIN s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY nth <= 10)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""
