"""Call-site traces and the flow report, stored indexes, versioned tables, ranks within hot groups."""

import threading

import pytest
from pyspark.sql import functions as F

from tarnwatch import shared
from tarnwatch.functions import catalog
from tarnwatch.operators import flow, reports, structure
from tarnwatch.operators.review import upsert_progress
from tarnwatch.operators.store import Conflict, Versioned
from tarnwatch.plans.graphs import sink_catalogue
from tarnwatch.sources.corpus import read_progress

FILES = [
    ("r", "src/a.py", "@s.tool()\ndef twice(x, y):\n    same(x)\n    same(y)\n    print(x)\n\ndef same(v):\n    os.system(v)\n\n@app.get('/x')\ndef page(request: Request):\n    same(request)\n"),
    ("r", "src/b.py", "def same(w):\n    return w\n\n@s.tool()\ndef idle():\n    return 1\n"),
    ("q", "src/c.py", "def nothing(a):\n    return a\n"),
]


def corpus(spark, rows=FILES):
    return spark.createDataFrame(rows, "repo string, file string, content string")


def built(spark, files):
    found = structure.functions_of(files).cache()
    calls = structure.calls_of(found)
    functions = flow.numbered(found.select("repo", "file", F.col("name").alias("func"), F.col("line_start").alias("func_line"), F.transform("params", lambda p: p["name"]).alias("params"), "is_tool", "is_call_tool", "is_http"))
    sinks = structure.sinks_of(calls, sink_catalogue(spark), sink_catalogue(spark, catalog.SINKS_JS))
    return functions, flow.call_sites(functions, calls), flow.sinks_by_function(functions, sinks)


def test_flow_report_read_back(spark, tmp_path):
    files = corpus(spark)
    functions, edges, sinks = built(spark, files)
    reports.write_lines(flow.report_lines(functions, edges, sinks, files), str(tmp_path / "out"), text="line", per_file=7)
    read = lambda repo: [line for f in sorted((tmp_path / "out" / f"repo={repo}").glob("part=*/*.txt")) for line in f.read_text().splitlines()]
    assert read("r") == [
        "Flow report — r", "Indexed 5 function(s) in 2 file(s); 2 entry point(s).",
        "━━━ TOOL: twice  [src/a.py:2] ━━━", "Parameters (all user-controlled):", "  • x", "  • y", "Call tree (depth 4):", "  twice",
        "  ├─ same  [src/a.py:3]", "  │  ⚡ [HIGH] COMMAND: os.system  (via: v)", "  │  └─ system  (external)".replace("system", "os.system"), "  ├─ same  [src/b.py:3]", "  ├─ same  [src/a.py:4]", "  │  ⚡ [HIGH] COMMAND: os.system  (via: v)", "  │  └─ os.system  (external)", "  ├─ same  [src/b.py:4]", "  └─ print  (external)",
        "Result: 2 sink(s) reached",
        "━━━ TOOL: idle  [src/b.py:5] ━━━", "Parameters: (none)", "Call tree (depth 4):", "  idle", "  └─ (no outgoing calls found or no input flows out)", "Result: CLEAN — no dangerous sinks reached within depth 4",
        "━━━ HTTP HANDLERS ━━━", "  [HIGH] page [src/a.py:11]  COMMAND: same → os.system [line 8] — via same() at line 12", "3 total finding(s).",
    ]
    assert read("q") == ["Flow report — q", "Indexed 1 function(s) in 1 file(s); 0 entry point(s).", "No dangerous sinks reachable from tool handlers or HTTP request parsers."]


def test_flow_of_an_empty_corpus(spark):
    files = corpus(spark).limit(0)
    assert flow.report_lines(*built(spark, files), files).count() == 0


def test_hot_callees_are_spread(spark):
    left = spark.range(20_000).select((F.col("id") % 10 == 0).alias("hot"), "id").select(F.lit("r").alias("repo"), F.when(F.col("hot"), "get").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("callee"), "id")
    right = spark.createDataFrame([("r", "get", 1), ("r", "get", 2), ("r", "f1", 3)], "repo string, callee string, target int")
    joined = shared.salted_join(left, right, ["repo", "callee"]).cache()
    assert joined.count() == 18_000 + 2 * 2000 and joined.where("target = 3").count() == 1 and joined.where("callee = 'get'").groupBy("id").count().where("count <> 2").count() == 0
    salts = left.where("callee = 'get'").select(F.pmod(F.xxhash64("repo", "callee", "id"), F.lit(64)).alias("s")).groupBy("s").count()
    assert salts.agg(F.max("count")).first()[0] <= 2 * 2000 / 64 + 30


def test_ranks_within_a_hot_repository(spark):
    rows = [("hot" if i % 10 else f"r{i % 7}", (i * 7919) % 1000) for i in range(2000)] + [(None, 5), (None, 1)]
    df = spark.createDataFrame(rows, "repo string, n int").repartition(5)
    got = {}
    for r in shared.ranked_within(df, "repo", [F.col("n")], "place").collect():
        got.setdefault(r["repo"], []).append((r["place"], r["n"]))
    want = {}
    for repo, n in rows:
        want.setdefault(repo, []).append(n)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(sorted(p for p, _ in v) == list(range(1, len(v) + 1)) for v in got.values())


def test_index_parses_a_content_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def work(file, text):
        (seen / f"{file.replace('/', '_')}-{abs(hash(text))}-{threading.get_ident()}").touch()
        return structure.records(file, text)

    path = str(tmp_path / "index")
    first = structure.FunctionIndex(spark, path, work).update(corpus(spark))
    assert sorted(r["name"] for r in first.collect()) == ["idle", "nothing", "page", "same", "same", "twice"] and len(list(seen.iterdir())) == 3
    changed = [FILES[0], ("r", "src/b.py", "x = 1\n"), ("q", "src/d.py", "def more(a):\n    pass\n")]
    for f in seen.iterdir():
        f.unlink()
    again = structure.FunctionIndex(spark, path, work).update(corpus(spark, changed))
    assert sorted(r["name"] for r in again.collect()) == ["more", "page", "same", "twice"]
    assert sorted(f.name.split("-")[0] for f in seen.iterdir()) == ["src_b.py", "src_d.py"]
    for f in seen.iterdir():
        f.unlink()
    structure.FunctionIndex(spark, path, work).update(corpus(spark, changed)).collect()
    assert not list(seen.iterdir())  # src/b.py holds no function and is known all the same


def test_a_crash_between_the_steps_leaves_the_version_before(spark, tmp_path):
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    path = str(tmp_path / "progress")
    upsert_progress(spark, urls(), urls("b", "a"), path)
    table = Versioned(spark, path, "url string")
    table.stage(urls("lost"))  # stopped before the pointer
    assert [r["url"] for r in read_progress(spark, path).collect()] == ["a", "b"]
    number, _ = table.current()
    (tmp_path / "progress" / f"_at-{number + 1}").touch()  # stopped within the pointer
    assert [r["url"] for r in read_progress(spark, path).collect()] == ["a", "b"]
    upsert_progress(spark, urls("a"), urls("c", None), path)
    assert [r["url"] for r in read_progress(spark, path).collect()] == ["a", "b", "c"]
    with pytest.raises(Conflict):
        table.publish(table.stage(urls("late")), number)


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "progress")
    one = lambda k: [upsert_progress(spark, spark.createDataFrame([], "url string"), spark.createDataFrame([(f"{k}{i}",)], "url string"), path) for i in range(4)]
    threads = [threading.Thread(target=one, args=(k,)) for k in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["url"] for r in read_progress(spark, path).collect()) == [f"{k}{i}" for k in "ab" for i in range(4)]
    assert len(list((tmp_path / "progress").glob("v-*"))) <= 4


def test_html_page_is_whole(spark):
    states = spark.createDataFrame([("r<", "js", 1, None, -1, 0, 2, 1)], "repo string, language string, flow int, network int, stream int, auth int, static int, findings int")
    sections = spark.createDataFrame([("r<", 2, "B", "b", 0), ("r<", 1, "A", None, 3)], "repo string, place int, title string, body string, count int")
    findings = spark.createDataFrame([("r<", 2, "LOW", "low", "f", 1, None), ("r<", 1, "HIGH", "high", "", None, "d & e")], "repo string, id long, severity string, title string, file string, line int, description string")
    page = [r["html"] for r in reports.html_page(states, sections, findings).orderBy("place").collect()]
    text = "".join(page)
    assert len(page) == 8 and page[0].startswith("<!doctype html>") and page[-1].endswith("</html>") and "r&lt;" in page[0]
    assert text.index("<h2>A") < text.index("<h2>B") < text.index("<table>") < text.index("<td>high") < text.index("<td>low") and "d &amp; e" in text and text.count("<tr>") == 3
