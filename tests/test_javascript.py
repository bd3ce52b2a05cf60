"""The JavaScript front end: nested templates, regular expressions, names of tools, and broken files, which cost no more than their size."""

import time

import pytest

from tarnwatch.operators import extract_js


def calls(source, name):
    found = next(r for r in extract_js.index_js(source) if r["name"] == name)
    return {c["dotted"]: (c["influenced"], c["dynamic"]) for c in found["calls"]}


def test_balanced_interpolations():
    assert calls("function f(cmd) { cp.exec(`ls ${g({a: cmd})}`); }", "f")["cp.exec"] == (["cmd"], False)
    assert calls("function f(cmd) { cp.exec(`a ${x ? `b ${cmd} {` : ''} c`); y(`}`); }", "f") == {"cp.exec": (["cmd"], True), "y": ([], False)}


@pytest.mark.parametrize("text", ["/[\"'`(]/.test(x)", "x.replace(/\\/\\*/g, '')", "a / b / c(x)", "`\\`${'`'}`", "x // `\n", "/* ` */ x", "'\\'' + x"])
def test_what_looks_like_a_quote(text):
    assert calls(f"function f(x) {{ {text}; sink(x); }} function g(y) {{ sink(y); }}", "f")["sink"] == (["x"], False)
    assert calls(f"function f(x) {{ {text}; sink(x); }} function g(y) {{ sink(y); }}", "g")["sink"] == (["y"], False)


@pytest.mark.parametrize(
    ("first", "name"),
    [("'lit'", "lit"), ("`lit`", "lit"), ("NAMES.first", "first"), ("SECOND", "SECOND"), ("config.name", "name_L2"), ("toolName", "toolName_L2"), ("`a${b}`", "unknown_L2"), ("{ name: 'x', title: 'y' }", "x"), ("{ name: NAMES.z }", "z"), ("{ description: 'a' }", "unknown_L2"), ("/* 'no' */ 'yes'", "yes")],
)
def test_names_of_tools(first, name):
    found = extract_js.index_js(f"\nserver.tool({first}, async ({{ p }}) => {{ eval(p); }});")
    assert [(r["name"], r["is_tool"]) for r in found] == [(f"tool__{name}", True)] and found[0]["calls"][0]["influenced"] == ["p"]


def test_a_callback_is_taken_whole():
    tool = extract_js.index_js("s.tool('t', z.object({ a: z.map(v => v) }), async ({ list, cmd }) => {\n  list.forEach(p => { cp.exec(cmd + p); });\n});")[0]
    assert [p["name"] for p in tool["params"]] == ["list", "cmd"] and [c["dotted"] for c in tool["calls"]] == ["list.forEach", "cp.exec"]


def test_parameters_and_assignments():
    assert extract_js.parameters("{ a, b: c, d = 1, e: { f } }, [g, h], ...rest, i: string = '', j?") == ["a", "c", "d", "f", "g", "h", "rest", "i", "j"]
    assert calls("function f(a) { const { b, c: d } = a; let e; e += d; const [g] = e; sink(g); arr[i] = a; other(i); }", "f") == {"sink": (["g"], False), "other": ([], False)}


def test_declarations_are_no_calls():
    assert list(calls("function f(a) { function inner(b) { sink(b); } return inner(a); }", "f")) == ["sink", "inner"]


BROKEN = {
    "unclosed registrations": 's.tool("x", async (a) => { exec(a);\n' * 10_000, "unclosed parentheses": 's.tool("x", async (a) => { exec(a); };\n' * 10_000, "round": "(" * 1_000_000, "curly": "{" * 1_000_000, "nested calls": "f(" * 20_000 + ")" * 20_000,
    "unclosed functions": "function a(x) { g(x);\n" * 10_000, "nested functions": "".join(f"function a{i}(x) {{\n" for i in range(3000)) + "}" * 3000, "templates": "`${" * 200_000, "quotes": "'" * 1_000_000, "arrows": "const f = " + "a=>" * 10_000 + "1",
    "object": "x={" + ",".join(f"a{i}:{i}" for i in range(80_000)) + "}", "chains": "a." * 500_000, "types": "const a: b c d " * 60_000, "generics": "function a<" * 90_000, "names": 's.tool({ name: "a\n' * 50_000, "comments": "/*" * 500_000, "colons": "(a): " * 200_000,
    "assignments": "function q(v0){" + "".join(f"v{i}=v{i + 1};" for i in range(20_000, -1, -1)) + "}",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files_cost_their_size(name):
    start = time.process_time()
    extract_js.index_js(BROKEN[name])
    assert time.process_time() - start < 15  # about a second each; quadratic ones took minutes


def test_a_broken_registration_is_kept():
    found = extract_js.index_js('s.tool("a", async (x) => { eval(x);\ns.tool("b", async (y) => { eval(y); });\n')
    assert [(r["name"], [c["influenced"] for c in r["calls"]]) for r in found] == [("tool__a", [["x"]]), ("tool__b", [["y"]])]
