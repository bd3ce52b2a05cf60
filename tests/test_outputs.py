"""Reports, progress, stored results, run control: cases beside the registered queries."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tarnwatch.api import Corpus
from tarnwatch.functions import catalog
from tarnwatch.operators import control, extract_js, extract_py, patterns, reports, review
from tarnwatch.sources import corpus


def files(spark, *contents):
    return spark.createDataFrame([("r", f"src/f{i}.py", c) for i, c in enumerate(contents)], "repo string, file string, content string")


def test_redirects_and_requests_count_in_stream_files_only(spark):
    plain, stream = "import flask\nreturn redirect(next)\nrequests.get(u, stream=True)", "x = 'text/event-stream'\nreturn redirect(next)\nrequests.get(u, stream=True)"
    code = files(spark, plain, stream)
    assert [(r["file"], r["line"]) for r in patterns.redirects(code).collect()] == [("src/f1.py", 2)]
    assert [(r["file"], r["line"]) for r in patterns.stream_ssrf(code).collect()] == [("src/f1.py", 3)]


def test_progress_round_trip(spark, tmp_path):
    path = str(tmp_path / "done")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    read = lambda: sorted(r["url"] for r in corpus.read_progress(spark, path).collect())
    assert read() == []
    review.upsert_progress(spark, corpus.read_progress(spark, path), urls("b", "a"), path)
    assert read() == ["a", "b"]
    review.upsert_progress(spark, corpus.read_progress(spark, path), urls("c", "a"), path)
    review.upsert_progress(spark, corpus.read_progress(spark, path), urls('q"uo\\te'), path)
    assert read() == ["a", "b", "c", 'q"uo\\te']
    array = tmp_path / "array.json"
    array.write_text(json.dumps(["x", "y"], indent=2))
    assert sorted(r["url"] for r in corpus.read_progress(spark, str(array)).collect()) == ["x", "y"]


def test_stored_validations(spark, tmp_path):
    assert corpus.read_validation(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "validation_result.json").write_text(json.dumps({"canary_verified": True, "confirmed": 2, "validated_findings": [{"id": 1, "verdict": "confirmed"}], "summary": "s"}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("")
    r = corpus.read_validation(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["confirmed"] == 2 and r[0]["validated_findings"][0]["verdict"] == "confirmed"


def test_settings():
    assert corpus.setting("K", {"K": "file"}, {"K": "env"}) == "file" and corpus.setting("K", {"K": ""}, {"K": "env"}) == "env" and corpus.setting("K", {}, None, "d") == "d"


@pytest.mark.parametrize(("source", "name"), [("requests.Session().get(u)", "get"), ("a.b.c(u)", "a.b.c"), ("x[0].open(u)", "open"), ("f()(u)", "")])
def test_call_names_begin_behind_calls_and_subscripts(source, name):
    calls = extract_py.index_python(f"def f(u):\n    {source}\n")[0]["calls"]
    assert (name in [c["dotted"] for c in calls]) == bool(name)
    assert all(not c["dotted"].startswith("requests.Session.") for c in calls)


def test_new_function_and_templates():
    build, run = extract_js.index_js("function build(code) { return new Function(code); }\nfunction run(x) { exec(`a ${x} b`); exec(`${y}`); }\n")
    assert [c["dotted"] for c in build["calls"]] == ["new Function"]
    assert [(c["dotted"], c["dynamic"]) for c in run["calls"]] == [("exec", True)]


def test_a_function_keeps_its_own_body():
    one, two = extract_js.index_js("function one(p) { return a(p); }\nconst two = (q) => { b(q); };\n")
    assert [c["callee"] for c in one["calls"]] == ["a"] and [c["callee"] for c in two["calls"]] == ["b"]


def test_reports_are_written_in_order(spark, tmp_path):
    rows = [("r1", i, f"block {i}") for i in range(1, 51)] + [("r2", 1, "only")]
    df = spark.createDataFrame(rows, "repo string, place long, block string").repartition(7)
    manifest = reports.write_lines(df, str(tmp_path / "out"), per_file=8)
    text = [line for f in sorted((tmp_path / "out" / "repo=r1").glob("part=*/*.txt")) for line in f.read_text().splitlines()]
    assert text == [f"block {i}" for i in range(1, 51)]
    assert [tuple(r) for r in manifest.where("repo = 'r1'").orderBy("part").select("first", "last", "lines").collect()] == [(i, min(i + 7, 50), min(8, 51 - i)) for i in range(1, 51, 8)]


def test_gate_of_minus_one(spark):
    costs = spark.createDataFrame([(4.0,), (2.0,)], "cost double")
    assert [reports.ask_first(costs, t).first()["ask"] for t in (-1.0, 5.0, 6.0, 6.1)] == [False, True, True, False]
    assert reports.ask_first(costs.limit(0), 0.0).first()["total"] == 0.0


def test_timeouts(spark):
    slow = lambda: spark.range(2).repartition(2).mapInPandas(lambda it: (time.sleep(30), it)[1], "id long").count()
    at = time.time()
    assert control.within(spark, 2.0, slow, "as it was") == ("as it was", True) and time.time() - at < 20
    assert control.within(spark, 60, lambda: spark.range(5).count()) == (5, False) and control.within(spark, 0, lambda: 1) == (1, False)
    with pytest.raises(ValueError):
        control.within(spark, 60, lambda: int("x"))


def test_many_runs(spark):
    seen = []
    out = control.run_all(spark, {"a": lambda: spark.range(3).count(), "b": lambda: 1 // 0, "c": lambda: "c"}, workers=2, seen=lambda name, done, n: seen.append((done, n)))
    assert out["a"] == (3, None) and out["c"] == ("c", None) and out["b"][0] is None and "zero" in out["b"][1] and seen[-1] == (3, 3)


def test_sessions(spark):
    s = control.Session(Corpus(files(spark, "eval(x)\n")), turns=3, reads=3)
    assert s.call("search_code", pattern="eval").count() == 1 and s.call("nothing") == "unknown tool nothing"
    assert [isinstance(s.call("read_file", path=p), str) for p in ("src/f0.py", "src/f0.py", "src/f0.py", "b", "c")] == [False, False, True, False, True]
    assert s.calls["read_file"] == 5 and s.call("list_files").count() == 1
    assert s.run(lambda answers: [("list_files", {})]).cut_short
    done = control.Session(s.corpus).run(lambda answers: [("run_analyzer", {"name": "js"})] if not answers else [("report_findings", {"findings": [1], "summary": "x"})])
    assert done.findings == [1] and not done.cut_short and done.calls == {"run_analyzer": 1, "report_findings": 1}


def test_one_scan_finds_what_the_modules_find(spark):
    code = files(spark, 'password = "hunter22"\n# password = "hunter23"\nskip_auth = True secure=False', "yield 'data:'\nreturn redirect(next)\nrequests.get(u, stream=True)\n# return redirect(next)", "return redirect(next)", 'x = jwt.decode(t, verify=False)\napi_key = "changeme123"')
    c = Corpus(code)
    columns = ["repo", "type", "severity", "file", "line", "match"]
    for m in patterns.FUSED:
        alone = sorted(map(tuple, c.run(m).select(columns).collect()))
        assert sorted(map(tuple, c.scan(sorted(patterns.FUSED)).where(F.col("module") == m).select(columns).collect())) == alone
    assert {r["module"] for r in c.scan(sorted(patterns.FUSED)).collect()} >= {"credentials", "jwt", "redirect", "ssrf"}


def test_the_execute_property_of_a_tool():
    tool = extract_js.index_js("server.addTool({ name: 'x', execute: async (args) => { eval(args); }, done: (z) => { other(z); } });\n")[0]
    assert [c["callee"] for c in tool["calls"]] == ["eval"] and tool["params"][0]["name"] == "args"


def test_fixed_values_are_text():
    assert catalog.VALIDATION_OVERHEAD == 1200 and catalog.PYTHON_MARKERS[0] == "setup.py"
