"""The five stages, one after the other, over odd rows: each is held against a plain version on its own input."""

import random

import pytest
from test_lines_and_packing import brute_lines, reference_ids
from test_near import brute
from test_native import brute_targets

import corpus_pipeline
from tarnwatch.llm import common, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, place int"


def odd_corpus(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(260):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            text += "\nvile " + "trash scum vile trash scum filth " * 4
        if i % 4 == 0:
            text += "\nA passage that is repeated in very many of these documents, over and over"
        rows.append((i, text, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}", len(text)))
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows += [(1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, " \n ", "en", "s0", 3), (None, rows[5][1], "en", "s1", 1), (7, rows[7][1], "en", "s2", 1), (7, rows[7][1], "en", "s2", 1), (1003, rows[8][1].upper(), "en", "s0", 1), (1004, long, "en", "s1", len(long))]
    return spark.createDataFrame([(*r, "c", 4) for r in rows], SCHEMA)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    docs = odd_corpus(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    docs, labels = (docs.limit(0), labels.limit(0)) if empty else (docs, labels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = docs
        docs = common.stored(lambda stage=stage, docs=docs: stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name != "packing":
            assert docs.columns == at[name].columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, docs.select(columns).collect()))
    if empty:
        assert whole.count() == 0
        return
    # toxicity: the model's own rule, text by text
    model = toxicity.train_toxicity(at["toxicity"], labels)
    kept = [(r["doc_id"], r["text"]) for r in at["toxicity"].collect() if model.score(r["text"]) < 0.5]
    assert texts_of(at["line_dedup"]) == sorted(kept, key=repr)
    assert not any(d is not None and d < 260 and d % 9 == 0 for d, _ in kept) and len(kept) > 200
    # line dedup
    want = brute_lines([(d, t) for d, t in texts_of(at["line_dedup"])])
    assert sorted(((d, t or "") for d, t in texts_of(at["near_duplicates"])), key=repr) == sorted(((d, t) for d, t, _ in want), key=repr)
    # near duplicates: the smallest id of every group of five-word shingles, and all rows without words
    rows = texts_of(at["near_duplicates"])
    groups = brute(rows, 5)
    stay = {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
    left = texts_of(at["mixing"])
    assert {d for d, _ in left} == stay and len(left) == len({c for _, n, c in groups if n}) + sum(not n for _, n, _ in groups)
    # mixing: rows come whole, at most three times, near their source's target
    sizes, taken = {}, {}
    for r in at["mixing"].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in at["packing"].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    longest = max(len((t or "").split()) for _, t in left)
    assert set(texts_of(at["packing"])) <= set(left)
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest
    # packing: every id of every row once
    ids = reference_ids()
    assert sum(r["length"] for r in docs.collect()) == sum(len(ids(t or "")) for _, t in texts_of(at["packing"]))


def test_intermediate_tables_are_deleted(spark, tmp_path):
    docs = odd_corpus(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: len(fs.listStatus(folder)) if fs.exists(folder) else 0
    before = count()
    out = common.stored(lambda: corpus_pipeline.near_duplicates_go(spark, docs, ""), "test-near")
    assert out.count() > 0 and count() == before + 1


def test_stored_leaves_the_tables_of_other_runs(spark):
    """A table that another thread writes meanwhile stays, and nested results go with the outer one."""
    import threading

    other, ready, go = {}, threading.Event(), threading.Event()

    def beside():
        other["table"] = common.stored(lambda: common.write_table(spark.range(5).toDF("n"), "beside"), "beside-out")
        ready.set()
        go.wait(60)
        other["n"] = other["table"].count()

    thread = threading.Thread(target=beside)
    inner = []

    def step():
        thread.start()
        ready.wait(60)
        inner.append(common.stored(lambda: common.write_table(spark.range(3).toDF("n"), "inner"), "inner-out"))
        return inner[0].withColumn("m", inner[0]["n"] + 1)

    out = common.stored(step, "outer")
    go.set()
    thread.join()
    assert out.count() == 3 and other["n"] == 5
    for table in (out, other["table"]):
        common.drop_table(table)
    path = inner[0]._tarnwatch_path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
