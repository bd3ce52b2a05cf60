"""Line dedup and packing against brute force."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from tarnwatch.llm import line_dedup, packing

SCHEMA = "doc_id long, text string, n_chars int, pos string, doc string, kind string"


def line_documents(spark, seed, n=60):
    rng = random.Random(seed)
    pool = [("Line %d " % i) + "x" * rng.choice([5, 33, 34, 40, 80]) for i in range(12)] + ["", " " * 50, "É" * 40, "A" * 40]
    rows = [(i, "\n".join(rng.choice([s, s.upper(), "  " + s + "\t", s]) for s in rng.choices(pool, k=rng.randint(0, 9))), 1, "p", "d", "k") for i in range(n)]
    rows += [(n, None, 1, "p", "d", "k"), (n + 1, "", 1, "p", "d", "k"), (None, "A" * 40, 1, "p", "d", "k"), (5, rows[5][1], 1, "p", "d", "k"), (n + 2, ("A" * 40 + "\n") * 5000, 1, "p", "d", "k")]
    return spark.createDataFrame(rows, SCHEMA)


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            held.setdefault(key(s), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda s: len(key(s)) >= min_chars and len(held[key(s)]) >= min_docs and max(held[key(s)], key=lambda d: (d is not None, d or 0)) != i
        out.append((i, "\n".join(s for s in lines if not gone(s)), len(lines)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "partitions", "batch"), [(1, 4, 10000), (2, 13, 3), (3, 1, 7)])
def test_lines(spark, seed, partitions, batch):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        docs = line_documents(spark, seed)
        out = line_dedup.drop_repeated_lines(docs)
        assert out.columns == docs.columns
        got = out.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=repr) == sorted(((i, t) for i, t, _ in want), key=repr)
    assert all(r["n_chars"] in (1, len(r["text"] or "")) for r in got)


def test_lines_sql_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(line_dedup.OP9_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, line_dedup.op9_line_dedup(spark, sf).collect())) == sorted(want)
    assert line_dedup.drop_repeated_lines(line_documents(spark, 1).limit(0)).count() == 0


@pytest.mark.parametrize("positions", [[0], [7], [8, 3], [0, 1, 2, 63, 64]])
def test_bitmaps(positions):
    text = "\n".join(map(str, range(70)))
    kept, n = line_dedup.kept_lines(text, line_dedup.pack_bits(positions))
    assert n == 70 and kept == [str(i) for i in range(70) if i not in positions]


def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 0]


def test_token_ids_are_those_of_the_tokenizers_library():
    ids = reference_ids()
    texts = ["", "a", "Hello,  world\n\n x", " \t ", "don't stop", "é ñ 漢字  x", "tabs\t\tand \n lines \n", "x" * 3000, "1 2 33 444 !!! $$$the", "trailing ", "a\x1c\x1c b\x85\u2003 \u3000c"]
    texts += ["<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>  b", "<|endoftext", " <|endoftext|>\n\n"]
    texts += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rng = random.Random(6)
    texts += ["".join(rng.choice(["a", "B", "1", ".", " ", "\n", "\t", "'s", "é", "\xa0", "<|endoftext|>", "漢"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        assert packing.token_ids(text).tolist() == ids(text), repr(text)
    assert ids("<|endoftext|>") == [50256, 0]


@pytest.mark.parametrize("run", [" ", "\n", " \t", "\u2003", "x", "ab", "7", "!", "漢"])
def test_long_runs_are_tokenised(run):
    ids = reference_ids()
    for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE):
        for text in (run * n, f"a{run * n}b", f"{run * n}\nb  c{run * n} ", f"é {run * n}<|endoftext|>{run * n}"):
            assert packing.token_ids(text).tolist() == ids(text)


@pytest.mark.parametrize("run", [" ", "\n", "x"])
def test_a_million_of_one_character(run):
    assert packing.token_ids(run * 1_000_000 + "z").tolist() == reference_ids()(run * 1_000_000 + "z")


def test_five_million_spaces():
    assert len(packing.token_ids("a" + " " * 5_000_000 + "b")) == 5_000_002


@pytest.mark.parametrize(("n", "capacity"), [(0, 8), (1, 8), (8, 8), (9, 8), (16, 8), (23, 8)])
def test_cut(n, capacity):
    pieces = packing.cut(np.arange(n), capacity)
    assert sum(k for _, k in pieces) == n and all(k == capacity for _, k in pieces[1:]) and [s for s, _ in pieces] == list(np.cumsum([0, *(k for _, k in pieces[:-1])]))


def test_sum_of_squares_takes_the_best_place():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 11, 300), 10
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    levels: dict[int, int] = {}
    squares = lambda lv: sum(np.bincount([capacity - x for x in lv.values() if x < capacity], minlength=1) ** 2)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert levels.get(b, 0) == o and o + n <= capacity
        options = [squares(levels | {x: v + n}) for x, v in levels.items() if v + n <= capacity] + [squares(levels | {-1: n})]
        levels[b] = o + n
        assert squares(levels) == min(options)


def test_pack_documents(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "zebra", "q9"]) for _ in range(rng.choice([3, 30, 300])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 9000), (None, "x"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, piece int, length string")
    got = packing.pack_documents(docs, capacity=512, group_items=100).collect()
    by, total = {}, 0
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 512
    assert total == sum(len(packing.token_ids(t)) for _, t in rows) and len(by) <= 1.03 * total / 512 + 4
    pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 302)
    ids = packing.token_ids(rows[302][1])
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in pieces) and sum(n for _, _, n, _ in pieces) == len(ids)
    assert packing.pack_documents(docs.limit(0)).count() == 0
