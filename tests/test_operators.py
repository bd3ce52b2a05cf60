"""Unit cases of the operators."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwatch.api import Corpus
from tarnwatch.functions import catalog, text
from tarnwatch.operators import extract_js, extract_py, patterns, review, structure, trace
from tarnwatch.streaming import incremental


def files(spark, *contents, name="src/a.py"):
    return spark.createDataFrame([("r", name if i == 0 else f"src/f{i}.py", c) for i, c in enumerate(contents)], "repo string, file string, content string")


@pytest.mark.parametrize(("line", "n"), [('api_key = "sk-live-12345"', 1), ('# password = "hunter22"', 0), ('password = "changeme"', 0), ('pwd = "ab"', 0), ("", 0)])
def test_credentials(spark, line, n):
    assert patterns.check_patterns(files(spark, "x = 1\n" + line), catalog.CREDENTIALS, "HARDCODED_CREDENTIAL").count() == n


def test_first_pattern_of_a_line_wins(spark):
    found = patterns.check_patterns(files(spark, "SESSION_COOKIE_SECURE = False\nsecure=False httponly=False"), catalog.INSECURE_SESSION, "S").collect()
    assert sorted((r["line"], r["detail"]) for r in found) == [(1, "Cookie secure flag disabled"), (2, "Cookie secure flag disabled")]


@pytest.mark.parametrize(("path", "skip"), [("src/tests/a.py", True), ("src/test_a.py", True), ("src/a_spec.ts", True), ("src/contest.py", False), ("demo-app.js", True), ("a.py", False)])
def test_skip_path(spark, path, skip):
    assert spark.range(1).select(text.skip_path(F.lit(path))).first()[0] is skip


def test_lines_of_matches(spark):
    rows = ["", "a", "eval(x)\n\neval(y) eval(z)", "é eval (\nq)\n" * 3, "\n\n\n", "no\r\neval(1)"]
    pattern = r"eval\s*\([^)]*\)"
    got = patterns.all_matches(files(spark, *rows), [(pattern, "d")]).collect()
    want = sorted((m[0], s.count("\n", 0, m.start()) + 1) for s in rows for m in re.finditer(pattern, s))
    assert sorted((r["match"], r["line"]) for r in got) == want


@pytest.mark.parametrize(("line", "host", "severity"), [('app.run(host="0.0.0.0", port=80)', "0.0.0.0", "HIGH"), ("app.listen(3000, '127.0.0.1')", "127.0.0.1", "MEDIUM"), ("app.listen(3000)", "(unresolved)", "MEDIUM")])
def test_bindings(spark, line, host, severity):
    r = patterns.network_bindings(files(spark, line)).collect()
    assert [(x["host"], x["severity"]) for x in r] == [(host, severity)]


@pytest.mark.parametrize(("chars", "tokens"), [(0, 1), (3, 1), (7, 2), (35, 10)])
def test_tokens(spark, chars, tokens):
    assert spark.range(1).select(text.estimate_tokens(F.lit(chars))).first()[0] == tokens


def test_head_and_tail(spark):
    out = spark.range(1).select(text.head_and_tail(F.lit("a" * 60_001), 60_000, "|")).first()[0]
    assert out == "a" * 42_000 + "|" + "a" * 18_000


def graph(spark, source):
    f = structure.functions_of(files(spark, source))
    from tarnwatch.plans.graphs import sink_catalogue

    functions = f.select("name", F.transform("params", lambda p: p["name"]).alias("params"), "is_tool", "is_call_tool", "is_http")
    calls = structure.calls_of(f)
    sinks = structure.sinks_of(calls, sink_catalogue(spark), sink_catalogue(spark, catalog.SINKS_JS))
    return functions, calls.select("func", "line", "callee", "pos", "kw", "star"), sinks.select("func", "line", "sink_type", "influenced")


@pytest.mark.parametrize(
    ("source", "n"),
    [
        ("@s.tool()\ndef t(cmd):\n    os.system(cmd)\n", 1),
        ("@s.tool()\ndef t(a):\n    os.system('ls')\n", 1),
        ("@s.tool()\ndef t(cmd):\n    c = cmd\n    os.system(c)\n", 0),
        ("@s.tool()\ndef t(cmd):\n    h(cmd)\ndef h(x):\n    eval(x)\n", 1),
        ("@s.call_tool()\ndef t(name, arguments):\n    os.system(name)\n", 0),
        ("@s.tool()\ndef t(x):\n    a(x)\n    b(x)\ndef a(x):\n    c(x)\ndef b(x):\n    c(x)\ndef c(x):\n    eval(x)\n", 2),
        ("@s.tool()\ndef a(x):\n    b(x)\ndef b(x):\n    a(x)\n    eval(x)\n", 1),
        ("@s.tool()\ndef t(u):\n    urllib.request.urlopen(u)\n", 1),
        ("@s.tool()\ndef t(d):\n    h(**d)\ndef h(p):\n    eval(p)\n", 1),
    ],
)
def test_trace(spark, source, n):
    functions, calls, sinks = graph(spark, source)
    nodes, _ = trace.trace(functions, calls)
    assert trace.sink_counts(nodes, sinks).first()["n"] == n


def test_trace_depth(spark):
    source = "@s.tool()\ndef t(x):\n    f1(x)\n" + "".join(f"def f{i}(x):\n    f{i + 1}(x)\n" for i in range(1, 6))
    functions, calls, _ = graph(spark, source)
    assert {r["func"] for r in trace.trace(functions, calls)[0].collect()} == {"t", "f1", "f2", "f3", "f4"}
    assert {r["func"] for r in trace.trace(functions, calls, 0)[0].collect()} == {"t"}


def test_python_that_does_not_parse():
    assert extract_py.index_python("def f(:\n") == [] and extract_py.taint_v2("(") == [] and extract_py.call_graph_v1("\0") == ([], [])


def test_nested_functions_keep_their_calls():
    outer, inner = extract_py.index_python("def f(a):\n    def g(b):\n        eval(b)\n    print(a)\n")
    assert [c["callee"] for c in outer["calls"]] == ["print"] and [c["callee"] for c in inner["calls"]] == ["eval"]


def test_javascript():
    src = "// exec(a)\nserver.tool('run', async ({ cmd }) => {\n  const c = cmd + 1;\n  exec(c);\n  const s = 'eval(x)';\n});\nfunction h(p) {\n  fs.readFile(p)\n}\n"
    tool, h = extract_js.index_js(src)
    assert tool["name"] == "tool__run" and [(c["dotted"], c["line"], c["influenced"]) for c in tool["calls"]] == [("exec", 4, ["c"])]
    assert h["name"] == "h" and h["calls"][0]["line"] == 8


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="'\"`/*\\${}() \nab", max_size=60))
def test_blanking_keeps_length_and_lines(s):
    out, shown, partners = extract_js.lex(s)
    assert len(shown) == len(s) and all(out[a] + out[b] in ("()", "[]", "{}") for a, b in partners.items())
    assert len(out) == len(s) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(s) if c == "\n"]


@pytest.mark.parametrize(("broken", "fixed"), [('{"a":[1,2', '{"a":[1,2]}'), ('{"a": {"b": "c', None), ('{"a": 1}', '{"a": 1}')])
def test_repair(broken, fixed):
    got, _ = review.repair_json(broken)
    assert got == fixed if fixed else got is not None and got.startswith("{")


def test_merge(spark):
    f = spark.createDataFrame([("r", i, "LOW", f"t{i}", "a.py", 1) for i in (1, 2, 3)], "repo string, id long, severity string, title string, file string, line long")
    v = spark.createDataFrame([("r", 1, "confirmed", None, "e", 1), ("r", 2, "confirmed", None, "e", 1), ("r", 2, "false_positive", None, "e", 2)], "repo string, id long, verdict string, new_severity string, evidence string, seq int")
    new = spark.createDataFrame([("r", "HIGH", "n", "b.py", 2)], "repo string, severity string, title string, file string, line long")
    assert sorted((r["title"], r["verdict"]) for r in review.merge_verdicts(f, v, new).collect()) == [("n", "discovered"), ("t1", "confirmed"), ("t3", "confirmed")]


def test_api(spark):
    c = Corpus(files(spark, 'password = "hunter22"\neval(x)'))
    assert c.search("eval", "*.py").count() == 1 and c.list("sr").count() == 0 and c.list("src").count() == 1
    assert [r["shown"] for r in c.read("src/a.py", 2, 2).collect()] == ["    2 | eval(x)"]
    assert {r["module"] for r in c.scan().collect()} == {"credentials"}


def test_only_new_files_are_scanned(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    scan = lambda f: patterns.check_patterns(f, catalog.CREDENTIALS, "HARDCODED_CREDENTIAL")
    for n in (1, 2):
        files(spark, f'password = "hunter{n}{n}"', name=f"src/m{n}.py").write.mode("append").parquet(src)
        incremental.scan_new(incremental.stream_corpus(spark, src), scan, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == n
