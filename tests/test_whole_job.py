"""Cases in which an operator or query once did less than its whole job."""

import pytest

from tarnwatch.functions import catalog
from tarnwatch.operators import review, structure, trace
from tarnwatch.plans import graphs, registry


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_prompt_size_counts_every_document_of_six_sections(spark, tmp_path):
    rows = [(i, "x" * (100 + i), "a") for i in range(24)] + [(2, "y" * 130_000, "b"), (8, "z", "b"), (3, " \n", "b"), (None, None, None)]
    bodies = {"a": ["\n".join("x" * (100 + i) for i in range(k, 24, 6)) for k in range(6)], "b": ["", "", "y" * 84_000 + "\n\n...[TRUNCATED]...\n\n" + "y" * 36_000, "", "", ""], None: [""] * 6}
    want = {r: 800 + sum(len(f"## {t}\n\n{b or '(No findings or report unavailable.)'}\n") for t, b in zip(catalog.REPORT_SECTIONS, s, strict=True)) for r, s in bodies.items()}
    assert {r["repo"]: r["chars"] for r in registry.queries()["prompt_size"](spark, documents(spark, tmp_path, rows)).collect()} == want


def test_report_excerpts_are_whole_up_to_60_000(spark, tmp_path):
    long = "h" * 42_000 + "m" * 5 + "t" * 18_000
    rows = [(1, "a" * 2001, "s"), (2, "b" * 60_000, "s"), (3, long, "s"), (4, None, "s"), (5, "", "s")]
    got = {r["doc_id"]: r["excerpt"] for r in registry.queries()["truncate_70_30"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "h" * 42_000 + "\n\n...[TRUNCATED]...\n\n" + "t" * 18_000, 4: None, 5: ""}


@pytest.mark.parametrize("tail", [50, 500, 50_000])
def test_verdicts_survive_any_tail(spark, tail):
    reply = '{"canary": "c", "validated_findings": [{"id": 1, "verdict": "confirmed"}' + " " + "x" * tail
    r = review.check_replies(spark.createDataFrame([(1, reply, "c", 1)], "id long, reply string, canary string, expected int")).first()
    assert [(v["id"], v["verdict"]) for v in r["verdicts"]["validated_findings"]] == [(1, "confirmed")] and r["problems"] == ["truncated"]


def test_taint_closure_follows_long_chains(spark):
    steps = spark.createDataFrame([("f", f"v{i + 1}", f"v{i}") for i in range(1000)] + [("f", "v3", "v1000"), ("g", "w", "v0"), ("f", None, "v0")], "func string, target string, source string")
    known = trace.taint_closure(steps, spark.createDataFrame([("f", "v0"), ("h", "x")], "func string, name string"))
    assert {(r["func"], r["name"]) for r in known.collect()} == {("f", f"v{i}") for i in range(1001)} | {("h", "x")}


def test_sql_sinks_are_decided_by_the_operator(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i,) for i in range(60)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    seen, real = [], structure.sinks_of
    monkeypatch.setattr(structure, "sinks_of", lambda calls, *sinks: seen.append(calls) or real(calls, *sinks))
    got = {(r["id"], r["note"]) for r in graphs.QUERIES["sql_sinks"][0](spark, str(tmp_path)).collect()}
    assert seen[0].count() == 60 and {(r["dynamic"], len(r["influenced"])) for r in seen[0].collect()} == {(False, 0), (True, 0), (False, 1)}
    methods = [i for i in range(60) if graphs.DOTTED[i % 10].rsplit(".", 1)[-1] in catalog.SQL_METHODS_PY]
    assert methods and got == {(i, "dynamic SQL construction" if i % 3 == 1 else "") for i in methods if i % 3}
