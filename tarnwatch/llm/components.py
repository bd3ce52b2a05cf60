"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lookup, write_table


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges of each task as stars; a task holds ``most`` edges at a time."""

    def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = UnionFind(), 0

        def out() -> pd.DataFrame:
            u = np.fromiter(found.parent.keys(), dtype=np.int64, count=len(found.parent))
            return pd.DataFrame({"u": u, "v": np.array([found.find(int(x)) for x in u], dtype=np.int64)})

        for frame in frames:
            for a, b in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                found.union(a, b)
            n += len(frame)
            if n > most:
                yield out()
                found, n = UnionFind(), 0
        yield out()

    return edges.mapInPandas(stars, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), nulls and loops left out -> (id, component): the smallest id reachable, for every id with an edge.

    Every round is written to the shared folder; a node's neighbours are only ever reduced to their minimum, and a hub with over 1/1024 of the edges
    finds it in place, so no hub is gathered in one task.
    """
    now = write_table(_contract(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "edges-low")
        large = lookup(both, low, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = write_table(small, "edges")
        drop_table(now)
        drop_table(low)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
