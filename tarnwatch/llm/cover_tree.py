"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1 in double precision; cosine >= t is distance <= sqrt(2 - 2 t) = tau.  Equal vectors are one point with a multiplicity.
Points go to the nearest of a bounded sample of centres, large cells are split by a hash, and so the points lie in blocks of about ``block_rows``.  A cover tree is built
in every block: nested levels of centres, the covering radius halving from level to level, from the diameter of the sphere down, every point below a centre within its radius.
A traversal of the tree with itself finds the links inside the block.  Each block is a ball, too: its centre and covering radius.  A pair of blocks whose balls are farther apart than both
radii and tau is pruned before any row of it is sent; the balls are compared in chunks, so their number is not bounded either.  Every pair of blocks that is left is one group, in
which both trees are traversed together: from the top levels down, a pair of nodes is pruned if its centres are farther apart than both radii and tau, is linked as a whole
if even its farthest points are within tau, and is opened one level down otherwise; points left at the end are compared directly.
So no pair is missed and none is compared below a pruned pair of nodes.  What leaves a group is a count of links per point and a spanning forest of the blocks' own components, never all pairs.

Bounds only prune what lies in clusters.  Unrelated vectors of many dimensions all lie about sqrt(2) apart, within the reach of every ball, and then each pair of blocks is met and nearly each pair of
points compared: exact search grows with the square of the number of such vectors.  ``dual_pairs`` can count what it compares.

Defined results: a null vector, a zero vector and one with null or non-finite components link with nothing (n_links 0, kept); vectors of different lengths are not
compared; repeated rows and equal vectors are linked; a null vec_id comes last when the smallest id of a component is chosen; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, lookup, table, write_table
from .components import UnionFind, connected_components

RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-7
SPREAD = 2048  # centres that are chosen far from each other
STRIP, LEAF = 512, 16384  # nodes or points compared at a time; point pairs below which a node pair is compared directly


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """A centre (position) for each point: greedy, in order, every point within radius of its centre and centres farther apart."""
    n = len(x)
    centre = np.full(n, -1, dtype=np.int64)
    low = 1 - (radius * radius) / 2
    for s in range(0, n, 256):
        if (centre[s : s + 256] >= 0).all():
            continue
        near = x[s : s + 256] @ x.T >= low
        for i in range(s, min(s + 256, n)):
            if centre[i] < 0:
                mine = near[i - s] & (centre < 0)
                mine[i] = True
                centre[mine] = i
    return centre


def cover_tree(x: np.ndarray, radii: tuple[float, ...] = RADII) -> np.ndarray:
    """The centre of each point on each level, as positions (points x levels); a level refines the one above and keeps its centres."""
    levels, above = np.zeros((len(x), len(radii)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for k, radius in enumerate(radii):
        order = np.argsort(above, kind="stable")
        cuts = np.flatnonzero(np.diff(above[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            head = above[part[0]]
            part = np.r_[head, part[part != head]] if k else part  # the centre above leads its node, so levels are nested
            levels[part, k] = part[net(x[part], radius)] if len(part) > 1 else part
        above = levels[:, k]
    return levels


class Ranges:
    """Lists of positions, kept in one array: item i is a slice of it."""

    def __init__(self, owner: np.ndarray, n: int) -> None:
        self.order = np.argsort(owner, kind="stable")
        self.ends = np.searchsorted(owner[self.order], np.arange(n + 1))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.order[self.ends[i] : self.ends[i + 1]]


class Nodes:
    """The nodes of each level: centre, members, radius, and the nodes of the next level below."""

    def __init__(self, x: np.ndarray, levels: np.ndarray) -> None:
        self.x, self.centres, self.members, self.radius, self.below = x, [], [], [], []
        for k in range(levels.shape[1]):
            c, own = np.unique(levels[:, k], return_inverse=True)
            gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[levels[:, k]])))
            radius = np.zeros(len(c))
            np.maximum.at(radius, own, gap)
            self.centres.append(c), self.members.append(Ranges(own, len(c))), self.radius.append(radius + SLACK)
            if k:
                self.below.append(Ranges(np.searchsorted(self.centres[k - 1], levels[c, k - 1]), len(self.centres[k - 1])))


def dual_pairs(a: Nodes, b: Nodes, threshold: float, tally: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(points of a, points of b, matrix of links) of the node pairs with links; None stands for all of them.
    tally, if given, counts the distances taken: between ``centres`` and between ``points``."""
    tally = {} if tally is None else tally
    tally.update(centres=0, points=0)
    tau, last = float(np.sqrt(max(0.0, 2 - 2 * threshold))), len(a.centres) - 1
    # unrelated points of many dimensions are about sqrt(2) apart: the traversal starts at the widest level that can tell them
    top = next((k for k in range(last) if 2 * RADII[k] + tau < np.sqrt(2)), last)
    todo: list = []
    # the top level is compared in strips of nodes of like radius; single precision, with room for its error, decides what is looked at closely
    by_a, by_b = np.argsort(a.radius[top], kind="stable"), np.argsort(b.radius[top], kind="stable")
    xa, xb = (n.x[n.centres[top][by]].astype(np.float32) for n, by in ((a, by_a), (b, by_b)))
    for s in range(0, len(by_a), STRIP):
        rows = by_a[s : s + STRIP]
        for t in range(0, len(by_b), STRIP):
            cols = by_b[t : t + STRIP]
            reach = float(a.radius[top][rows].max() + b.radius[top][cols].max() + tau)
            tally["centres"] += len(rows) * len(cols)
            i, j = np.nonzero(xa[s : s + STRIP] @ xb[t : t + STRIP].T >= 1 - reach * reach / 2 - 1e-4)
            i, j = rows[i], cols[j]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.x[a.centres[top][i]], b.x[b.centres[top][j]])))
            near = d <= a.radius[top][i] + b.radius[top][j] + tau
            todo += list(zip(i[near].tolist(), j[near].tolist(), d[near].tolist(), [top] * int(near.sum()), strict=True))
    while todo:
        i, j, d, k = todo.pop()
        ri, rj = a.radius[k][i], b.radius[k][j]
        left, right = a.members[k][i], b.members[k][j]
        if d + ri + rj <= tau - SLACK and len(left) * len(right) > 1:
            yield left, right, None
        else:
            u, v = (a.below[k][i], b.below[k][j]) if k < last else (left, right)
            if k < last and len(left) * len(right) > LEAF and len(u) * len(v) * 8 <= len(left) * len(right):
                tally["centres"] += len(u) * len(v)
                near = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centres[k + 1][u]] @ b.x[b.centres[k + 1][v]].T)))
                p, q = np.nonzero(near <= a.radius[k + 1][u][:, None] + b.radius[k + 1][v][None, :] + tau)
                todo += list(zip(u[p].tolist(), v[q].tolist(), near[p, q].tolist(), [k + 1] * len(p), strict=True))
                continue
            # few points, or nodes below that are hardly larger than points: compared directly
            tally["points"] += len(left) * len(right)
            for s in range(0, len(left), STRIP):
                links = a.x[left[s : s + STRIP]] @ b.x[right].T >= threshold
                if links.any():
                    yield left[s : s + STRIP], right, links


def bipartite_forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) edges of a spanning forest of the links."""
    rows, cols = np.ones(links.shape[0], dtype=bool), np.ones(links.shape[1], dtype=bool)
    edges: list[tuple[int, int]] = []
    for root in np.flatnonzero(links.any(axis=1)):
        if not rows[root]:
            continue
        rows[root], stack = False, [(int(root), True)]
        while stack:
            at, is_row = stack.pop()
            new = np.flatnonzero((links[at] & cols) if is_row else (links[:, at] & rows))
            (cols if is_row else rows)[new] = False
            edges += [(at, int(y)) if is_row else (int(y), at) for y in new]
            stack += [(int(y), not is_row) for y in new]
    return edges


def nodes_of(frame: pd.DataFrame, dim: int) -> Nodes:
    levels = np.frombuffer(b"".join(frame["path"]), dtype=np.int32).reshape(len(frame), -1).astype(np.int64)
    return Nodes(np.frombuffer(b"".join(frame["unit"]), dtype=np.float64).reshape(len(frame), dim), levels)


def links_between(a: Nodes, b: Nodes, part_a: np.ndarray, part_b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, UnionFind]:
    """Links per point of a and of b, with their copies, and the parts (component of a point within its block) that they join."""
    ca, cb, joined = np.zeros(len(part_a), dtype=np.int64), np.zeros(len(part_b), dtype=np.int64), UnionFind()
    for left, right, links in dual_pairs(a, b, threshold):
        if links is None:
            ca[left] += copies_b[right].sum()
            cb[right] += copies_a[left].sum()
            for x in np.unique(np.r_[part_a[left], part_b[right]]).tolist():
                joined.union(int(part_a[left[0]]), x)
        else:
            ca[left] += links @ copies_b[right]
            cb[right] += copies_a[left] @ links
            for x, y in bipartite_forest(links):
                joined.union(int(part_a[left[x]]), int(part_b[right[y]]))
    return ca, cb, joined


def plant(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """frame (dim, block, rep, copies, unit) of one block with its tree (place, path), links inside the block (own) and component in it (part), and the block's ball."""
    frame = frame.sort_values("rep").reset_index(drop=True)
    x = np.frombuffer(b"".join(frame["unit"]), dtype=np.float64).reshape(len(frame), -1)
    levels = cover_tree(x)
    tree, rep, copies = Nodes(x, levels), frame["rep"].to_numpy(), frame["copies"].to_numpy()
    own, _, joined = links_between(tree, tree, rep, rep, copies, copies, threshold)
    mean = x.mean(axis=0)
    size = float(np.sqrt((mean * mean).sum()))
    centre = mean / size if size > 0.01 else x[0]
    ball = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) + SLACK
    # every ordered pair came once, with the point itself
    return frame.assign(place=np.arange(len(frame), dtype=np.int32), path=[p.tobytes() for p in levels.astype(np.int32)], own=own - copies, part=[joined.find(int(r)) for r in rep], centre=[centre.tobytes()] + [None] * (len(frame) - 1), ball=ball)


def block_pair(a: pd.DataFrame, b: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """Of two blocks: rows (rep, other, n); other null: rep has n links more; n null: two parts that are linked."""
    ca, cb, joined = links_between(nodes_of(a, dim), nodes_of(b, dim), a["part"].to_numpy(), b["part"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy(), threshold)
    rep, n = np.r_[a["rep"].to_numpy(), b["rep"].to_numpy()], np.r_[ca, cb]
    edges = np.array([(x, joined.find(x)) for x in joined.parent], dtype=np.int64).reshape(-1, 2)
    edges = edges[edges[:, 0] != edges[:, 1]]
    rep, n = rep[n > 0], n[n > 0]
    out = pd.DataFrame({"rep": np.r_[rep, edges[:, 0]]})
    out["other"] = pd.array(np.r_[np.zeros(len(rep), dtype=np.int64), edges[:, 1]], dtype="Int64")
    out["n"] = pd.array(np.r_[n, np.zeros(len(edges), dtype=np.int64)], dtype="Int64")
    out.loc[: len(rep) - 1, "other"] = pd.NA
    out.loc[len(rep) :, "n"] = pd.NA
    return out


def meeting_blocks(balls: DataFrame, threshold: float, chunk: int = 1024) -> DataFrame:
    """balls (dim, block, centre, ball) as the pairs (dim, i, j), i < j, that may hold links: centres no farther apart than both radii and tau.

    Pairs of chunks of balls are compared as matrices; a chunk is ``chunk`` blocks, so what is sent is a few thousandths of the points.
    """
    tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    own = F.floor(F.col("block") / chunk).cast("int")
    last = balls.groupBy("dim").agg(F.floor(F.max("block") / chunk).cast("int").alias("last"))
    spread = balls.join(last, "dim").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last")))).select("dim", F.least(own, "k").alias("p"), F.greatest(own, "k").alias("q"), own.alias("own"), "block", "centre", "ball")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        a, b = frame[frame["own"] == p], frame[frame["own"] == q]
        found = []
        if len(a) and len(b):
            xa, xb = (np.frombuffer(b"".join(f["centre"]), dtype=np.float64).reshape(len(f), -1) for f in (a, b))
            apart = np.sqrt(np.maximum(0, 2 - 2 * (xa @ xb.T)))
            i, j = np.nonzero(apart <= a["ball"].to_numpy()[:, None] + b["ball"].to_numpy()[None, :] + tau + SLACK)
            i, j = a["block"].to_numpy()[i], b["block"].to_numpy()[j]
            keep = i < j if p == q else np.ones(len(i), dtype=bool)
            found = np.stack([np.minimum(i, j)[keep], np.maximum(i, j)[keep]], axis=1)
        out = pd.DataFrame(np.array(found, dtype=np.int32).reshape(-1, 2), columns=["i", "j"])
        return out.assign(dim=np.int32(frame["dim"].iloc[0]))[["dim", "i", "j"]]

    return spread.groupBy("dim", "p", "q").applyInPandas(compare, "dim int, i int, j int")


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x: the farthest from those chosen before, so that every cluster of the sample gets one, up to ``SPREAD`` of them, then the next ones in order."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, SPREAD, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    left = np.setdiff1d(np.arange(len(x)), chosen)[: max(0, n - len(chosen))]
    return x[np.unique(np.r_[chosen, left])]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) as (rid, vec_id, dim, unit); unit is null for vectors that link with nothing."""

    @F.pandas_udf("binary")
    def scale(values: pd.Series) -> pd.Series:
        def one(v) -> bytes | None:
            if v is None or len(v) == 0 or any(c is None for c in v):
                return None
            x = np.asarray(v, dtype=np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                return None
            x = x / top
            return (x / np.sqrt((x * x).sum()) + 0.0).tobytes()  # + 0.0: no negative zeros

        return values.map(one, na_action=None)

    whole = F.when(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c)), F.col("embedding"))
    return vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"), scale(whole.cast("array<double>")).alias("unit"))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block_rows: int = 4096, max_cells: int = 16384, centre_bytes: int = 8 << 20, seed: int = 67) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): rid, vec_id, n_links, component_id, first (of its component).
    At most ``max_cells`` centres, and ``centre_bytes`` of them, are sampled for vectors of one length."""
    rows = write_table(unit_vectors(vectors), "op6-rows")
    points = write_table(rows.where("unit IS NOT NULL").groupBy("dim", "unit").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "op6-points")
    dims = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centres = {}
    for dim, n in dims.items():
        most = max(1, min(max_cells, centre_bytes // (8 * dim), -(-n // block_rows)))
        few = points.where(F.col("dim") == dim).orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(most + 3 * min(most, SPREAD)).select("unit").collect()
        centres[dim] = spread_out(np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in few]), most)

    @F.pandas_udf("int")
    def cell(dim: pd.Series, unit: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), dtype=np.int32)
        for d in dim.unique():
            at = np.flatnonzero(dim.to_numpy() == d)
            for s in range(0, len(at), 2048):
                x = np.stack([np.frombuffer(u, dtype=np.float64) for u in unit.iloc[at[s : s + 2048]]])
                out[at[s : s + 2048]] = (x @ centres[d].T).argmax(axis=1)
        return pd.Series(out)

    celled = write_table(points.withColumn("cell", cell("dim", "unit")), "op6-cells")
    sizes = celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).orderBy("dim", "cell").collect()  # max_cells rows per length at most
    plan, used = [], {}
    for r in sizes:
        parts = -(-r["n"] // block_rows)
        plan.append((r["dim"], r["cell"], used.get(r["dim"], 0), parts))
        used[r["dim"]] = used.get(r["dim"], 0) + parts
    spark = vectors.sparkSession
    plan = spark.createDataFrame(plan, "dim int, cell int, base int, parts int")
    placed = celled.join(F.broadcast(plan), ["dim", "cell"]).withColumn("block", (F.col("base") + F.pmod(F.xxhash64("rep", F.lit(seed + 1)), F.col("parts"))).cast("int"))
    tree = "dim int, block int, rep long, copies long, unit binary, place int, path binary, own long, part long, centre binary, ball double"
    trees = write_table(placed.select("dim", "block", "rep", "copies", "unit").groupBy("dim", "block").applyInPandas(lambda frame: plant(frame, threshold), tree), "op6-trees")
    balls = trees.where("centre IS NOT NULL").select("dim", "block", "centre", "ball")
    pairs = write_table(meeting_blocks(balls, threshold), "op6-pairs")
    meets = pairs.select("dim", "i", "j", F.explode(F.array("i", "j")).alias("block"))
    sent = trees.select("dim", "block", "place", "rep", "copies", "part", "unit", "path").join(meets, ["dim", "block"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "place"])
        dim, i = int(frame["dim"].iloc[0]), int(frame["i"].iloc[0])
        mine = frame["block"] == i
        return block_pair(frame[mine].reset_index(drop=True), frame[~mine].reset_index(drop=True), dim, threshold)

    found = write_table(sent.groupBy("dim", "i", "j").applyInPandas(meet, "rep long, other long, n long"), "op6-found")
    links = found.where("other IS NULL").select("rep", "n").unionByName(trees.select("rep", F.col("own").alias("n"))).groupBy("rep").agg(F.sum("n").alias("others"))
    edges = found.where("other IS NOT NULL").select(F.col("rep").alias("u"), F.col("other").alias("v")).unionByName(trees.where("part <> rep").select(F.col("rep").alias("u"), F.col("part").alias("v")))
    roots = connected_components(edges).select(F.col("id").alias("rep"), "component")
    each = points.join(links, "rep", "left").join(roots, "rep", "left").select("dim", "unit", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("root"))
    each = write_table(each, "op6-each")
    total = rows.count()
    linked = lookup(rows.where("unit IS NOT NULL"), each, ["dim", "unit"], "copies", total).select("rid", "vec_id", "n_links", "root")
    out = write_table(linked.unionByName(rows.where("unit IS NULL").select("rid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("root"))), "op6-out")
    firsts = write_table(out.groupBy("root").agg(F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "rid")).alias("least"), F.count("*").alias("size")), "op6-firsts")
    for done in (celled, trees, found, pairs, each):
        drop_table(done)
    return lookup(out, firsts, ["root"], "size", total).select("rid", "vec_id", "n_links", F.col("least.vec_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("first"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.95),
t AS (SELECT r AS a, r AS b FROM v UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b),
c AS (SELECT a AS r, min(vec_id) AS component_id FROM t JOIN v ON v.r = t.b GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.r = v.r
"""
