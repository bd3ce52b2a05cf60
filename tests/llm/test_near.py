"""Near-duplicates of texts and vectors against brute force."""

import random
import re
from math import comb
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import components, cover_tree, minhash


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 40, 200]))]
        for _ in range(rng.randint(1, 9)):
            out.append(" ".join(word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base))
    return [*out, out[0].upper(), out[0].replace(" ", "\n\t"), None, "", "  ", "one", "ONE", "one two three"]


def brute(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = groups(len(sets), links)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 512), (2, 4)])
def test_near_texts(spark, seed, blocks):
    rows = [(i * 3, t) for i, t in enumerate(near_texts(seed))]
    rows += [(None, rows[0][1]), rows[1]]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, rep string, rid int").repartition(3)
    got = minhash.near_duplicates(docs, width=4, bucket_rows=blocks, block_rows=blocks)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == brute(rows, 4)
    kept = minhash.keep_first(docs, width=4)
    assert kept.columns == docs.columns
    empty = sum(not (t or "").split() for _, t in rows)
    want = {c for d, n, c in brute(rows, 4) if n}
    assert kept.count() == len(want) + empty
    assert minhash.keep_first(docs.limit(0)).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(1)
    parts = minhash.masks()
    for _ in range(300):
        wrong = set(rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False).tolist())
        assert any(not wrong & set(p.tolist()) for p in parts)
    with pytest.raises(ValueError):
        minhash.masks(chunks=4, errors=1, radius=20)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)]
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "u long, v long").repartition(5)
    got = {r["id"]: r["component"] for r in components.connected_components(df).collect()}
    root = groups(2300, links)
    assert got == {x: root[x] for a, b in links if a != b for x in (a, b)} and components.connected_components(df.limit(0)).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[[i % 40]] + rng.normal(size=(1, 16)) * rng.choice([0.02, 0.1, 0.3, 1.0]) for i in range(400)]).astype(np.float32)
    x[7], x[8] = x[6], x[6] * 2
    return x


@pytest.mark.parametrize("block_rows", [4096, 50])
def test_near_vectors(spark, block_rows):
    x = vectors(block_rows)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] * 16), (905, []), (906, [1.0, 0.0]), (None, rows[0][1]), rows[1]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], "vec_id long, embedding array<float>, rep string, label int")
    got = cover_tree.near_vectors(df, block_rows=block_rows).collect()
    ids = [i for i, _ in rows] + [None, 1]
    v = np.array([e for _, e in rows] + [rows[0][1], rows[1][1]], dtype=np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T >= 0.95
    np.fill_diagonal(close, True)
    root = groups(len(v), [(a, b) for a, b in zip(*np.nonzero(close), strict=True) if a > b])
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, int(close[k].sum()) - 1, least[root[k]]) for k, i in enumerate(ids)] + [(i, 0, i) for i, _ in odd[:7]]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def clustered(n, centres, spread, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    x = base[np.arange(n) % centres] + rng.normal(size=(n, dim)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("centres", "spread", "most"), [(40, 0.15, 0.06), (40, 0.05, 0.03), (2000, 0.0, 1.01)])
def test_share_of_pairs_that_the_bounds_leave(centres, spread, most):
    """Of 2,000 points in 40 clusters a few per cent of the pairs are compared; of 2,000 unrelated ones all are, and both ways find the same links."""
    x = clustered(2000, centres, spread)
    tree, tally = cover_tree.Nodes(x, cover_tree.cover_tree(x)), {}
    links = sum(len(a) * len(b) if m is None else int(m.sum()) for a, b, m in cover_tree.dual_pairs(tree, tree, 0.95, tally))
    assert links == int((x @ x.T >= 0.95).sum())
    assert (tally["centres"] + tally["points"]) / len(x) ** 2 <= most


def test_block_pairs_are_pruned(spark):
    """64 well separated clusters in as many blocks: nearly all pairs of blocks are left out, at 1x and 4x the vectors, and all links are found."""
    for n in (640, 2560):
        x = clustered(n, 64, 0.03, seed=n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        kept = []
        real = cover_tree.meeting_blocks
        try:
            cover_tree.meeting_blocks = lambda balls, threshold, chunk=16: (lambda found: (kept.append((found.count(), balls.count())), found)[1])(real(balls, threshold, chunk))
            got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_vectors(df, block_rows=n // 64).collect()}
        finally:
            cover_tree.meeting_blocks = real
        assert got == dict(enumerate(((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()))
        pairs, blocks = kept[0]
        assert blocks >= 32 and pairs < 0.25 * blocks * (blocks - 1) / 2


def test_cover_tree_covers():
    x = vectors(5).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    levels = cover_tree.cover_tree(x)
    for k, radius in enumerate(cover_tree.RADII):
        assert (np.linalg.norm(x - x[levels[:, k]], axis=1) <= radius + 1e-6).all()
        assert (levels[levels[:, k], k] == levels[:, k]).all()
        if k:
            assert (levels[levels[:, k - 1], k] == levels[:, k - 1]).all()  # centres of a level stay centres below


def test_documented_loss_at_the_threshold():
    loss = sum(comb(minhash.SYMBOLS, k) * 0.2**k * 0.8 ** (minhash.SYMBOLS - k) for k in range(minhash.RADIUS + 1, minhash.SYMBOLS + 1))
    for text in (minhash.__doc__, (Path(__file__).parents[2] / "README.md").read_text()):
        assert float(re.search(r"probability of about ([\d.]+e-\d+)", text)[1]) == pytest.approx(loss, rel=0.01)


def test_only_texts_of_members_are_sent(spark):
    """Of many texts, those that no family holds are dropped by the bitmap before the join."""
    keys = spark.range(20_000).select(F.xxhash64("id").alias("text_hash"), "id")
    members = keys.where("id % 100 = 0").select("text_hash")
    kept = minhash.may_be_in(keys, "text_hash", members)
    ids = {r["id"] for r in kept.collect()}
    assert {i for i in range(0, 20_000, 100)} <= ids and len(ids) < 210 and kept.columns == keys.columns
    assert minhash.may_be_in(keys, "text_hash", members.limit(0)).count() == 0
    full = minhash.may_be_in(keys, "text_hash", members, bits=6)
    assert {r["id"] for r in full.collect()} >= {i for i in range(0, 20_000, 100)}
