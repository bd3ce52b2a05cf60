"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of ``symbols`` minhash values of b = 32 bits.  Two sets of similarity s differ in a share 1 - s of the
values, so pairs over the similarity threshold lie within a distance ``radius`` of differing values (64 values and radius 26 miss a pair at exactly 0.8
with a probability of about 4.35e-5, and less above).  By pigeonhole, if the values are split into chunks such that chunks * (errors + 1) > radius, two signatures
within the radius differ in ``errors`` values at most in some chunk; every choice of such values is masked in turn, and what is left of the chunk is a key.
So two signatures within the radius share a key, always.

Documents with equal sets are one representative.  Keys of one representative are dropped; in each other bucket signatures are compared (8 bits of each value, which can only
shrink the distance), and a spanning forest of the pairs within the radius is kept.  Its components, the families, hold all links; within each, full sets built from the whole
texts confirm the links that join different parts.

Large groups, buckets as well as families, take two steps.  First their members are dealt into blocks by a hash and each block is compared within itself, so every
row is sent once; components of all that was found follow.  Then only members of groups that still hold several components are sent again: those of the largest component in its
blocks, all others to every one of them, so that every pair of different components is compared and none within one.  What the second step needs, the members of large buckets
and the sets of large families, is written by the first one beside its edges, so neither keys nor texts are shuffled again.  So no group is gathered in one task, none is capped, and a
group of copies of one template is read once, whatever its size.  What stays quadratic is a group in which many members are close by signature and yet apart by their sets.

Defined results: documents without words have an empty set, link with nothing and are kept; equal sets are linked; very long texts are read whole; a null doc_id comes last when the smallest id
of a component is chosen (a component without ids has a null component_id and none kept); repeated rows get equal results; an empty table gives an empty
result; other columns are ignored by ``near_duplicates`` and kept by ``keep_first``.  Shingles are known by 64-bit hashes: ``n_shingles`` counts distinct hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, lookup, table, write_table
from .components import UnionFind, connected_components

SYMBOLS, RADIUS, CHUNKS, ERRORS = 64, 26, 14, 1
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX2
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased and words end at [\\x20\\x09-\\x0D], as bytes.lower() and bytes.split() do it."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mix(out * MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _multipliers(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(101)
    return rng.integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, symbols, dtype=np.uint64)


def minhash(values: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    a, b = _multipliers(symbols)
    best = np.full(symbols, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(values), 2048):
        np.minimum(best, (a[:, None] * values[None, s : s + 2048] + b[:, None]).min(axis=1), out=best)
    return (_mix(best) >> np.uint64(32)).astype(np.uint32)


def masks(symbols: int = SYMBOLS, chunks: int = CHUNKS, errors: int = ERRORS, radius: int = RADIUS) -> list[np.ndarray]:
    """The positions of each key: every chunk without each choice of ``errors`` of its positions."""
    if chunks * (errors + 1) <= radius:
        raise ValueError("too few chunks for this radius")
    out = []
    for part in np.array_split(np.arange(symbols), chunks):
        out += [np.setdiff1d(part, gone) for gone in combinations(part.tolist(), errors)]
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) as rows (rid, doc_id, text_hash, n_shingles, s1, s2, minhash, sig); (s1, s2, n_shingles) stands for the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = Words()
        for batch in batches:
            n, ids, values, sigs = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width, words)
                m = minhash(s)
                n.append(len(s)), ids.append(xxhash.xxh3_128_digest(s.tobytes())), values.append(m.tobytes()), sigs.append(m.astype(np.uint8).tobytes())
            h = np.frombuffer(b"".join(ids), dtype="<i8").reshape(-1, 2)
            columns = [*(batch.column(c) for c in ("rid", "doc_id", "text_hash")), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(values, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "text_hash", "n_shingles", "s1", "s2", "minhash", "sig"])

    columns = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return columns.mapInArrow(rows, "rid long, doc_id long, text_hash long, n_shingles long, s1 long, s2 long, minhash binary, sig binary")


def bucket_keys(reps: DataFrame) -> DataFrame:
    """reps (rep, minhash) as (key, rep), one row per mask."""
    positions = masks()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column("minhash").to_pylist()), dtype=np.uint32).reshape(-1, SYMBOLS).astype(np.uint64)
            for i, cols in enumerate(positions):
                h = np.full(len(m), i + 1, dtype=np.uint64)
                for c in cols:
                    h = _mix(h * MIX + m[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("rep")], names=["key", "rep"])

    return reps.select("rep", "minhash").mapInArrow(keys, "key long, rep long")


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    left, edges = np.ones(len(close), dtype=bool), []
    for root in range(len(close)):
        if not left[root]:
            continue
        left[root], stack = False, [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(close[at] & left)
            left[new] = False
            edges += [(at, int(x)) for x in new]
            stack += new.tolist()
    return edges


def dealt(df: DataFrame, group: str, n_blocks: Column, member: str) -> DataFrame:
    """df with (i, j), a block of its group, and ``part``, the member itself: nothing is joined yet."""
    own = F.pmod(F.xxhash64(member), F.greatest(n_blocks, F.lit(1)))  # the same in all buckets, so that they find the same edges
    return df.withColumn("i", own).withColumn("j", own).withColumn("part", F.col(member))


def apart(df: DataFrame, components: DataFrame, group: str, member: str, block_rows: Column) -> DataFrame:
    """The rows of df (group, member, ...), whose groups are large, that must meet others of a different component: (i, j) is a pair of blocks and ``part`` the component.

    The first blocks are those of the group's largest component, the others those of all other members; pairs of two first blocks are left out.
    """
    rows = df.join(components.select(F.col("id").alias(member), "component"), member, "left").withColumn("part", F.coalesce("component", F.col(member))).drop("component")
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    groups = parts.groupBy(group).agg(F.max(F.struct("n", F.col("part").alias("most"))).alias("top"), F.sum("n").alias("g")).select(group, "top.most", "top.n", "g").where("g > n")
    rows = rows.join(groups, group)
    n_first, n_other = F.ceil(F.col("n") / block_rows), F.ceil((F.col("g") - F.col("n")) / block_rows)
    hashed = F.xxhash64(member, group, F.lit(1))
    own = F.when(F.col("part") == F.col("most"), F.pmod(hashed, n_first)).otherwise(n_first + F.pmod(hashed, n_other))
    rows = rows.withColumn("_own", own).withColumn("_first", n_first).withColumn("_all", n_first + n_other)
    others = F.when(F.col("_own") < F.col("_first"), F.sequence(F.col("_first"), F.col("_all") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1))
    rows = rows.withColumn("_other", F.explode(others)).withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
    return rows.drop("_own", "_other", "_first", "_all", "most", "n", "g")


GROUP_SCHEMA = "u long, v long, group long, set binary"


def by_group(df: DataFrame, group: str, work: Callable[[pd.DataFrame, np.ndarray, dict], list[tuple[int, int]]]) -> DataFrame:
    """Rows of GROUP_SCHEMA: the edges (u, v) that work finds in each (group, i, j), and for every row that is ``large`` its (u = rep, group, set).

    Groups stream through sorted partitions; work(frame, cuts, sets) may leave sets of large rows in sets, by rep.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def ends(frame: pd.DataFrame) -> np.ndarray:
            k = frame[[group, "i", "j"]].to_numpy()
            return np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1

        def out(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            sets: dict = {}
            edges = np.array(work(frame, cuts, sets), dtype=np.int64).reshape(-1, 2)
            large = frame[frame["large"].to_numpy(dtype=bool)][[group, "rep"]].drop_duplicates()
            none = [None] * len(edges)
            return pd.DataFrame({
                "u": np.r_[edges[:, 0], large["rep"].to_numpy(dtype=np.int64)], "v": pd.array([*edges[:, 1].tolist(), *[None] * len(large)], dtype="Int64"),
                "group": pd.array([*none, *large[group].tolist()], dtype="Int64"), "set": pd.Series([*none, *(sets.get(r) for r in large["rep"])], dtype=object),
            })

        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            first, last = held[0].iloc[0], frame.iloc[-1]
            if all(first[c] == last[c] for c in (group, "i", "j")):
                continue  # the group goes on
            whole = pd.concat(held, ignore_index=True)
            cuts = ends(whole)
            held = [whole.iloc[cuts[-1] :]]
            yield out(whole.iloc[: cuts[-1]], np.r_[0, cuts])
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield out(whole, np.r_[0, ends(whole), len(whole)])

    return df.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j").mapInPandas(run, GROUP_SCHEMA)


def edges_of(found: DataFrame) -> DataFrame:
    return found.where("v IS NOT NULL").select("u", "v")


def close_signatures(frame: pd.DataFrame, cuts: np.ndarray, _: dict) -> list[tuple[int, int]]:
    """Spanning forests of the signatures within the radius, group by group, from the smallest member on, so that buckets of the same members find the same edges; members of one part count as joined."""
    of_group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    frame = frame.iloc[np.lexsort((frame["rep"].to_numpy(), of_group))]
    sigs = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint8).reshape(-1, SYMBOLS)
    reps, part, sizes, edges = frame["rep"].to_numpy(), frame["part"].to_numpy(), np.diff(cuts), []
    for k in np.unique(sizes):
        starts = cuts[:-1][sizes == k]
        if k == 1:
            continue
        if k <= 6:  # many small groups at once
            for a, b in combinations(range(int(k)), 2):
                near = ((sigs[starts + a] != sigs[starts + b]).sum(axis=1) <= RADIUS) & (part[starts + a] != part[starts + b])
                edges.append(np.stack([reps[starts[near] + a], reps[starts[near] + b]], axis=1))
            continue
        for s in starts:
            rows = sigs[s : s + k]
            kinds, at = np.unique(part[s : s + k], return_inverse=True)
            if len(kinds) == 1:
                continue
            whole = len(kinds) == k  # nothing is joined yet
            close = np.zeros((k, k), dtype=bool)
            for x in range(0, k, 64):
                close[x : x + 64] = (rows[x : x + 64, None, :] != rows[None, :, :]).sum(axis=2) <= RADIUS
            if whole:
                found = forest(close)
            else:
                joined, found = UnionFind(), []
                for x, y in zip(*np.nonzero(np.triu(close & (at[:, None] != at[None, :]))), strict=True):
                    if joined.union(int(at[x]), int(at[y])):
                        found.append((x, y))
            edges.append(np.array([(reps[s + a], reps[s + b]) for a, b in found], dtype=np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(edges), axis=0).tolist() if edges else []


def confirm(width: int, percent: int) -> Callable[[pd.DataFrame, np.ndarray, dict], list[tuple[int, int]]]:
    """Links between members of different parts, confirmed on full sets (of a text, or a set as it was written), as a spanning forest; the closest signatures are tried first."""

    def work(frame: pd.DataFrame, cuts: np.ndarray, written: dict) -> list[tuple[int, int]]:
        words, edges = Words(), []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            rows = frame.iloc[s:e].drop_duplicates("rep")
            reps, part, large = rows["rep"].tolist(), rows["part"].to_numpy(), bool(rows["large"].iloc[0])
            if len(np.unique(part)) < 2 and not large:
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"]] if "set" in rows else [shingle_set(t, width, words) for t in rows["text"]]
            if large:
                written.update((r, x.tobytes()) for r, x in zip(reps, sets, strict=True))
            if len(np.unique(part)) < 2:
                continue
            sigs = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(-1, SYMBOLS)
            size = np.array([len(x) for x in sets])
            order = []
            for x in range(len(reps) - 1):
                far = (sigs[x + 1 :] != sigs[x]).sum(axis=1)
                fits = np.minimum(size[x + 1 :], size[x]) * 100 >= percent * np.maximum(size[x + 1 :], size[x])
                at = np.flatnonzero((far <= RADIUS) & fits & (part[x + 1 :] != part[x]))
                order.append(np.stack([far[at], np.full(len(at), x), x + 1 + at], axis=1))
            order = np.concatenate(order)
            joined = UnionFind()
            for _, x, y in order[np.argsort(order[:, 0], kind="stable")].tolist():
                if joined.find(int(part[x])) == joined.find(int(part[y])):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    joined.union(int(part[x]), int(part[y]))
                    edges.append((reps[x], reps[y]))
        return edges

    return work


FILTER_BITS = 24


def may_be_in(df: DataFrame, key: str, members: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """df without rows whose key (a 64-bit hash) can't be among members: a bitmap of 2**bits places, broadcast as its words that are not empty (2**(bits - 6) at most), so other rows are dropped before they are sent anywhere."""
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = members.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_set"))
    return df.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.col("_set").bitwiseAND(bit) != 0).drop("_word", "_set")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bucket_rows: int = 512, block_rows: int = 512, block_shingles: int = 1_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text): rid, doc_id, text_hash, n_shingles, component_id, first (of its component, by doc_id and rid)."""
    rows = write_table(sketch(docs, width), "op5-rows")
    sets = write_table(rows.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "op5-sets")
    reps = write_table(rows.join(sets.select(F.col("rep").alias("rid")), "rid").select(F.col("rid").alias("rep"), "doc_id", "text_hash", "n_shingles", "minhash", "sig"), "op5-reps")
    close = close_pairs(reps, bucket_rows)
    families = write_table(connected_components(close).select(F.col("id").alias("rep"), F.col("component").alias("family")), "op5-families")
    members = families.join(reps.drop("minhash"), "rep")
    total = members.groupBy("family").agg(F.count("*").alias("g"), F.sum("n_shingles").alias("all_shingles"))
    n_blocks = F.greatest(F.ceil(F.col("g") / block_rows), F.ceil(F.col("all_shingles") / block_shingles))
    members = write_table(members.join(total, "family").select("family", "rep", "sig", F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), n_blocks.alias("n_blocks"), F.ceil(F.col("g") / n_blocks).alias("in_block")), "op5-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = may_be_in(texts, "text_hash", members.select(F.col("m_hash").alias("text_hash")))

    found = dealt(members, "family", F.col("n_blocks"), "rep").join(texts, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")))
    found = found.select("family", "i", "j", "rep", "part", "sig", "text", (F.col("n_blocks") > 1).alias("large"))
    links = write_table(by_group(found, "family", confirm(width, percent)), "op5-links")
    pairs = edges_of(links)
    large = members.where("n_blocks > 1")
    if not large.isEmpty():
        # what the blocks of large families left apart, with the sets that were written for them
        parts = write_table(connected_components(pairs), "op5-parts")
        rows_apart = apart(large.select("family", "rep", "sig", "in_block"), parts, "family", "rep", F.greatest(F.col("in_block"), F.lit(1)))
        sets_of = links.where("v IS NULL").select(F.col("u").alias("rep"), "set")
        again = rows_apart.join(sets_of, "rep").select("family", "i", "j", "rep", "part", "sig", "set", F.lit(False).alias("large"))
        pairs = pairs.unionByName(edges_of(write_table(by_group(again, "family", confirm(width, percent)), "op5-links")))
    links = pairs
    roots = connected_components(links).select(F.col("id").alias("rep"), "component")
    # a document without a set is a component by itself; roots are row numbers, so the two don't meet
    by_set = write_table(sets.join(roots, "rep", "left").select("s1", "s2", "n_shingles", "copies", F.coalesce("component", "rep").alias("root")), "op5-by-set")
    bare = rows.drop("minhash", "sig")
    placed = lookup(bare.where("n_shingles > 0"), by_set, ["s1", "s2", "n_shingles"], "copies", rows.count()).select("rid", "doc_id", "text_hash", "n_shingles", "root")
    placed = write_table(placed.unionByName(bare.where("n_shingles = 0").select("rid", "doc_id", "text_hash", "n_shingles", F.col("rid").alias("root"))), "op5-placed")
    firsts = write_table(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("least"), F.count("*").alias("size")), "op5-firsts")
    for done in (families, members):
        drop_table(done)
    out = lookup(placed, firsts, ["root"], "size", placed.count())
    return out.select("rid", "doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("first"))


def close_pairs(reps: DataFrame, bucket_rows: int) -> DataFrame:
    """Edges (u, v) of reps (rep, minhash, sig) whose components join all pairs of signatures within the radius."""
    keys = bucket_keys(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    met = keys.join(shared, "key").join(reps.select("rep", "sig"), "rep")
    blocks = dealt(met, "key", F.ceil(F.col("g") / bucket_rows), "rep").withColumn("large", F.col("g") > bucket_rows)
    found = write_table(by_group(blocks.select("key", "i", "j", "rep", "part", "sig", "large"), "key", close_signatures), "op5-close")
    large = found.where("v IS NULL").select(F.col("group").alias("key"), F.col("u").alias("rep"))
    if large.isEmpty():
        return edges_of(found).distinct()
    parts = write_table(connected_components(edges_of(found)), "op5-close-parts")
    rows = apart(large, parts, "key", "rep", F.lit(bucket_rows)).join(reps.select("rep", "sig"), "rep")
    more = write_table(by_group(rows.select("key", "i", "j", "rep", "part", "sig", F.lit(False).alias("large")), "key", close_signatures), "op5-close")
    return edges_of(found).unionByName(edges_of(more)).distinct()


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; columns stay as they are."""
    key = {"__tw_id": F.col("doc_id").cast("long"), "__tw_hash": F.xxhash64("text")}
    found = near_duplicates(docs.select("doc_id", "text"), width, percent)
    stay = found.where("first").groupBy(F.col("doc_id").alias("__p_id"), F.col("text_hash").alias("__p_hash")).agg(F.count("*").alias("__p_n"))
    both = docs.withColumns(key).join(stay.hint("merge"), F.col("__tw_id").eqNullSafe(F.col("__p_id")) & (F.col("__tw_hash") == F.col("__p_hash")))
    # rows equal in id and text can't be told apart, so any of them may stay
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    return both.withColumn("__tw_nth", nth).where("__tw_nth <= __p_n").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS sh FROM d
), u AS (SELECT r, unnest(sh) AS x FROM s
), p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b WHERE 100 * c >= 80 * (len(sa.sh) + len(sb.sh) - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), t AS (SELECT r AS a, r AS b FROM s UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b
), c AS (SELECT a AS r, min(doc_id) AS component_id FROM t JOIN s ON s.r = t.b GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.r = s.r
"""
