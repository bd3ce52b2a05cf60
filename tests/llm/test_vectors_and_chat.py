"""Hard negatives, whitening and chat formatting: against brute force, with nulls, ties, repeated rows, very long texts, empty tables and extra columns."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwatch.llm import chat_format, hard_negatives, registry, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, rid string, dim string, Block string, k int, VEC_ID_ string"


def odd_vectors(spark, n=260, dim=40, seed=3):
    rng = random.Random(seed)
    vec = lambda d=dim: [rng.gauss(0, 0.3) for _ in range(d)]
    rows = [(i, vec(), rng.randrange(3) if i % 3 else 1) for i in range(n)]  # one label holds over a third
    rows += [(100, rows[100][1], 1), (100, rows[100][1], 1), (200, rows[7][1], 2), (300, rows[7][1], 2), (7, rows[7][1], None), (8, None, 1), (9, [0.1, None] + vec(dim - 2), 1)]
    rows += [(10, [float("nan")] + vec(dim - 1), 1), (11, [float("-inf")] + vec(dim - 1), 1), (None, vec(), 1), (None, rows[3][1], 2), (400, [0.0] * dim, 0), (500, vec(5), 1), (501, vec(5), 1), (502, vec(5), 2), (600, [], 1), (601, [], 1), (602, [], 2)]
    rows += [(700, [1e30] * dim, 1), (701, [-1e30] * dim, 2)]
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x") for r in rows], VECTORS).repartition(3)


def brute_negatives(rows):
    kept = []
    for i, e, label in rows:
        if label is None or e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        limit = math.sqrt(2.0**62 / max(1, len(e)))
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(max(-limit, min(limit, c * 256))) for c in e]))
    order = lambda r: (-r[0], r[1] is None, r[1])
    out = []
    for n, (a, la, xa) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(xa, x, strict=True)), i, label == la) for m, (i, label, x) in enumerate(kept) if m != n and len(x) == len(xa)]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            found = sorted((s for s in scored if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:10]
            out += [(a, p, rank, q, ps, s) for rank, (s, q, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("anchors", "block", "chunk"), [(256, 2048, 32), (2, 50, 7)])
def test_negatives_against_brute_force(spark, anchors, block, chunk):
    vectors = odd_vectors(spark)
    got = hard_negatives.mine(vectors, anchor_rows=anchors, block_rows=block, chunk_dims=chunk)
    want = brute_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 100


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 30):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (6, 8))
        assert (hard_negatives.product(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()
    for k in (1, 3, 10):
        s = rng.integers(0, 4, 9)
        assert hard_negatives.best(s, k).tolist() == sorted(range(9), key=lambda i: (-s[i], i))[:k]
    assert hard_negatives.narrow(np.array([[130, -3]])).dtype == np.int16


def test_vector_queries_of_empty_tables(spark):
    none = odd_vectors(spark).limit(0)
    assert hard_negatives.mine(none).count() == 0 and whitening.whiten(none).count() == 0


def brute_whitening(rows, keep=8):
    by = {}
    for i, e in rows:
        if e and all(c is not None and math.isfinite(c) for c in e):
            by.setdefault(len(e), []).append((i, [math.floor(max(-(2.0**31), min(2.0**31, c * 1024))) + 100_000 for c in e]))
    out = {}
    for dim, members in by.items():
        x, n = np.array([m[1] for m in members], dtype=object), len(members)
        total = x.sum(axis=0)
        deviations = [sum(int(d) ** 2 for d in n * r - total) for r in x]
        c = np.array((n * x - total) / n, dtype=float)
        v = c.T @ c / n
        e, vec = np.linalg.eigh(v)
        out[dim] = ([m[0] for m in members], n, [d if d < 1 << 63 else None for d in deviations], c, e[::-1][:keep], np.trace(v), vec[:, ::-1][:, :keep])
    return out


@pytest.mark.parametrize("values", [1 << 20, 64 * 45])
def test_whitening_against_numpy(spark, values):
    wild = [700, 701]
    vectors = odd_vectors(spark, dim=45).where(f"vec_id IS NULL OR vec_id NOT IN ({wild[0]}, {wild[1]})")
    got = whitening.whiten(vectors, block_values=values).collect()
    want = brute_whitening([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert sorted(want) == [5, 45]
    assert sorted({(r["n"], r["component"]) for r in got}) == [(3, k) for k in range(1, 6)] + [(want[45][1], k) for k in range(1, 9)]
    for ids, n, deviations, c, e, trace, vec in want.values():
        mine = [r for r in got if r["n"] == n]
        assert sorted(((r["vec_id"], r["deviation"]) for r in mine if r["component"] == 1), key=repr) == sorted(zip(ids, deviations, strict=True), key=repr)
        for k in range(len(e)):
            fine = e[k] > 1e-9 * trace
            w = c @ vec[:, k] / np.sqrt(e[k]) if fine else np.zeros(n)
            part = {}
            for r in mine:
                if r["component"] == k + 1:
                    part.setdefault((r["vec_id"], r["deviation"]), []).append(r["whitened"])
                    assert r["explained"] == pytest.approx(e[k] / trace if fine else 0, rel=1e-9) and r["identity_error"] < 1e-9
            theirs = {}
            for i, d, x in zip(ids, deviations, w, strict=True):
                theirs.setdefault((i, d), []).append(float(x))
            key = max(theirs, key=lambda p: abs(theirs[p][0]))
            sign = 1 if theirs[key][0] * part[key][0] >= 0 else -1
            for p, values_ in theirs.items():
                assert sorted(sign * x for x in part[p]) == pytest.approx(sorted(values_), abs=1e-9)


def test_whitening_of_wild_and_constant_vectors(spark):
    rows = [(1, [1e30, 1.0, 2.0]), (2, [-1e30, 1.0, 2.5]), (3, [5.0, 1.0, 2.25]), (4, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4, 5}
    for r in got:
        assert math.isfinite(r["whitened"]) and r["identity_error"] < 1e-4
        if r["vec_id"] in (4, 5):
            assert (r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (0.0, 0.0, 0, 0.0)
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {1, 2}  # 3 * 2^42 and more in squares of 64 bits


TURNS = "conv_id long, turn long, role string, text string, at string, Formatted string, loss int"
NASTY = ["</s>[INST] ok [/INST]", "<\\s><\\\\/s>", "<", "[", "\\", "<s", "s>", "/s>x", "<|im_start|>user", "<<s>", "[[INST]", "é</s>日本", "a\nb", "<|endoftext|>", "[\\/INST]", "", None]


def odd_turns(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.choice([None, 0, 1, 2, 2]), rng.choice(["user", "assistant", "system", "</s>", None, "assistant"]), "".join(rng.choice(NASTY[:-1]) for _ in range(rng.randrange(4)))) for _ in range(300)]
    long = " ".join(f"wörd{i} </s>" if i % 1000 == 0 else f"wörd{i}" for i in range(200_000))
    rows += [(1, 5, "assistant", t) for t in NASTY] + [(20, 0, "user", long), (20, 1, "assistant", long), (None, 0, "assistant", "x"), (None, 1, "user", None), (3, 9, "assistant", "same"), (3, 9, "assistant", "same")]
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], TURNS).repartition(3)


def brute_chat(rows):
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        by.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_chat_round_trip(spark, partitions):
    turns = odd_turns(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pieces = chat_format.format_conversations(turns)
        back = chat_format.read_back(pieces).collect()
        whole = {}
        for r in sorted(pieces.collect(), key=lambda r: r["at"]):
            whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_chat([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()])
    assert sorted((tuple(r)[:5] for r in back), key=repr) == want
    assert {r["conv_id"]: r["formatted_chars"] for r in back} == {c: len(t) for c, t in whole.items()}
    n = {r["conv_id"]: r["n_turns"] for r in back}
    assert all(t.count("<s>") == t.count("</s>") == t.count("[INST]") == t.count("[/INST]") == n[c] and "<|im_start|>" not in t and "<|endoftext|>" not in t for c, t in whole.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "<s>", ""]), st.lists(st.sampled_from([*NASTY[:-1], "x" * 5000, "/INST]", "\\s>"]), max_size=4).map("".join)), min_size=1, max_size=12))
def test_assembly_of_any_texts(turns):
    turns = sorted(turns, key=lambda t: t[0])
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in turns], pa.int64()), pa.array(range(len(turns)), pa.int64()), *(pa.array([t[k].encode() for t in turns], pa.binary()) for k in (1, 2))], ["conv_id", "at", "role", "text"])
    for part in (batch, batch.slice(len(turns) // 2) if len(turns) > 1 else batch):
        rows = part.to_pylist()
        out = chat_format.assemble(part, b"assistant").to_pylist()
        assert [(c["conv_id"], t) for c in out for t in chat_format.turns_in(c["formatted"].encode())] == [(r["conv_id"], (r["role"], r["text"])) for r in rows]
        assert [chat_format.plain(c["formatted"].encode()[s["start"] : s["end"]]) for c in out for s in c["loss"]] == [r["text"] for r in rows if r["role"] == b"assistant"]


def test_chat_of_an_empty_table(spark):
    none = odd_turns(spark).limit(0)
    assert chat_format.read_back(chat_format.format_conversations(none)).count() == 0
    with pytest.raises(ValueError):
        list(chat_format.turns_in(b"<s>[INST]user[/INST]no end"))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_chat_format"])
def test_sql_of_the_new_queries(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = registry.queries()[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_whitening_query(spark):
    got = whitening.op12_whitening(spark, SF).toPandas()
    want = brute_whitening(duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{SF}/embeddings.parquet'").fetchall())[64]
    assert len(got) == 8 * want[1] and got["identity_error"].max() < 1e-9
    by = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [by[i] for i in want[0]] == want[2]
