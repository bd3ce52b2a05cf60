"""Python source -> functions, calls and call arguments, through the standard parser.  Files that don't parse give no rows.

The parser is the one step that no SQL expression can do; what it finds is matched against catalogues by joins.
"""

from __future__ import annotations

import ast

from ..functions import catalog

SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


#: Fields of each kind of node that may hold other nodes; marks such as Load and Add are left out.
FIELDS = {kind: [f for f in kind._fields if f not in ("ctx", "op", "ops", "id", "attr", "type_comment")] for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)}


def children(node: ast.AST) -> list[ast.AST]:
    out = []
    for field in FIELDS[type(node)]:
        held = getattr(node, field, None)
        if isinstance(held, ast.AST):
            out.append(held)
        elif isinstance(held, list):
            out += [x for x in held if isinstance(x, ast.AST)]
    return out


def definitions(tree: ast.AST) -> list[ast.AST]:
    """Functions of a file, outer ones first.  Only statements hold them, so expressions are passed over."""
    queue = [tree]
    for node in queue:  # grows meanwhile
        for field in ("body", "handlers", "orelse", "finalbody", "cases"):
            queue += getattr(node, field, ())
    return [n for n in queue if isinstance(n, DEFS)]


def own_nodes(function: ast.AST) -> list[ast.AST]:
    """Nodes of the body that belong to this function, in the order of the source: nested functions and classes are left to themselves."""
    out, stack = [], function.body[::-1]
    while stack:
        node = stack.pop()
        if isinstance(node, SCOPES[:3]):
            continue
        out.append(node)
        stack += children(node)[::-1]
    return out


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of an attribute chain on a name; a chain on a call or a subscript counts from there on: ``f().b.c`` is ``b.c``."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names))


def named(node: ast.AST) -> str:
    """dotted of a chain that begins with a name; empty for others."""
    start = node
    while isinstance(start, ast.Attribute):
        start = start.value
    return dotted(node) if isinstance(start, ast.Name) else ""


def names(node: ast.AST) -> list[str]:
    queue = [node]
    for x in queue:  # grows meanwhile
        queue += children(x)
    return [x.id for x in queue if isinstance(x, ast.Name)]


def targets(node: ast.AST) -> set[str]:
    """Plain names that an assignment binds; attributes and subscripts bind none."""
    if isinstance(node, ast.Name):
        return {node.id}
    if isinstance(node, ast.Starred):
        return targets(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        return set().union(*map(targets, node.elts))
    return set()


def tainted(nodes: list[ast.AST], start: set[str]) -> set[str]:
    """start and every name that nodes assign from it, directly or through other names."""
    flows = []
    for node in nodes:
        if isinstance(node, ast.Assign):
            flows.append((set().union(*map(targets, node.targets)), set(names(node.value))))
        elif isinstance(node, (ast.AugAssign, ast.AnnAssign)) and node.value is not None:
            flows.append((targets(node.target), set(names(node.value))))
    known, before = set(start), -1
    while len(known) != before:
        before = len(known)
        known = known.union(*(left for left, right in flows if right & known))
    return known


def call_row(node: ast.Call, known: set[str]) -> dict:
    placed = [names(a) for a in node.args]
    worded = [(k.arg, names(k.value)) for k in node.keywords]
    used = {n for found in [*placed, *(found for _, found in worded)] for n in found}
    full = dotted(node.func)
    return {
        "callee": full.rsplit(".", 1)[-1], "dotted": full, "line": node.lineno, "pos": placed, "kw": {word: found for word, found in worded if word},
        "star": any(known & set(found) for word, found in worded if word is None), "influenced": sorted(used & known),
        "shell": any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords),
        "dynamic": any(isinstance(a, (ast.JoinedStr, ast.BinOp)) for a in node.args),
    }


def index_python(source: str) -> list[dict]:
    """One record per function, with its role, parameters and distinct calls (by dotted name and line)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for f in definitions(tree):
        params = [{"name": a.arg, "annotation": ast.unparse(a.annotation) if a.annotation else ""} for a in f.args.args if a.arg not in ("self", "cls")]
        marks = [dotted(d.func if isinstance(d, ast.Call) else d) for d in f.decorator_list]
        kinds = {m.rsplit(".", 1)[-1] for m in marks if "." in m}
        nodes = own_nodes(f)
        known = tainted(nodes, {p["name"] for p in params})
        calls = {}
        for node in nodes:
            if isinstance(node, ast.Call) and (row := call_row(node, known))["callee"]:
                calls.setdefault((row["dotted"], row["line"]), row)
        out.append({
            "name": f.name, "line_start": f.lineno, "line_end": f.end_lineno, "params": params, "decorators": marks,
            "is_tool": "tool" in kinds, "is_call_tool": "call_tool" in kinds, "is_http": bool(kinds & set(catalog.HTTP_VERBS)) or any("Request" in p["annotation"] for p in params),
            "calls": list(calls.values()),
        })
    return out


def call_graph_v1(source: str) -> tuple[list[tuple[str, str]], list[tuple[str, int]]]:
    """(caller, callee) of bare-name calls inside functions, and (call, line) of the first scan's dangerous calls."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    edges, risky = [], []
    bad = {x for module, fs in catalog.CALLS_V1.items() for f in fs for x in (f"{module}.{f}", f)}

    def visit(node: ast.AST, inside: str | None) -> None:
        if isinstance(node, DEFS):
            inside = node.name
        if isinstance(node, ast.Call):
            if inside and isinstance(node.func, ast.Name):
                edges.append((inside, node.func.id))
            if (full := named(node.func)) in bad:
                risky.append((full, node.lineno))
        for child in ast.iter_child_nodes(node):
            visit(child, inside)

    visit(tree, None)
    return sorted(set(edges)), risky


def sink_v2(node: ast.Call) -> str | None:
    parts = named(node.func).split(".")
    if len(parts) == 1:
        return parts[0] if parts[0] in catalog.SINKS_V2["builtins"] + catalog.SINKS_V2["open"] else None
    module, last = parts[0], parts[-1]
    if len(parts) != 2 or last not in catalog.SINKS_V2.get(module, []):
        return None
    if module == "yaml" and (any(k.arg == "Loader" for k in node.keywords) or len(node.args) > 1):
        return None
    return f"{module}.{last}"


def built_string(node: ast.AST) -> bool:
    return isinstance(node, ast.JoinedStr) or (isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod))) or (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format")


def taint_v2(source: str) -> list[dict]:
    """Direct sinks with a parameter, SQL built from strings, and calls that hand a parameter on to a sink of the same file."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    functions = [n for n in ast.walk(tree) if isinstance(n, DEFS)]
    passes: dict[str, set[int]] = {}
    for f in functions:
        order = [a.arg for a in f.args.args]
        passes[f.name] = {order.index(n) for c in own_nodes(f) if isinstance(c, ast.Call) and sink_v2(c) for a in c.args for n in names(a) if n in order}
    out = []
    for f in functions:
        mine = {a.arg for a in f.args.args}
        for c in (n for n in own_nodes(f) if isinstance(n, ast.Call)):
            sink = sink_v2(c)
            if sink and any(mine & set(names(a)) for a in c.args):
                out.append({"type": "TAINTED_SINK", "func": f.name, "line": c.lineno, "sink": sink, "severity": "HIGH"})
            if isinstance(c.func, ast.Attribute) and c.func.attr in catalog.SQL_METHODS_V2 and c.args and built_string(c.args[0]):
                out.append({"type": "SQL_INJECTION", "func": f.name, "line": c.lineno, "sink": c.func.attr, "severity": "HIGH"})
            if isinstance(c.func, ast.Name) and any(i in passes.get(c.func.id, ()) and mine & set(names(a)) for i, a in enumerate(c.args)):
                out.append({"type": "INTERPROCEDURAL", "func": f.name, "line": c.lineno, "sink": c.func.id, "severity": "HIGH"})
    return out


def unvalidated_auth(source: str) -> list[dict]:
    """Functions with a credential parameter and no word of validation in their source."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for f in (n for n in ast.walk(tree) if isinstance(n, DEFS)):
        hit = sorted({a.arg.lower() for a in f.args.args} & set(catalog.AUTH_PARAMETERS))
        if hit and not any(w in ast.unparse(f).lower() for w in catalog.VALIDATION_WORDS):
            out.append({"type": "UNVALIDATED_AUTH_PARAM", "func": f.name, "line": f.lineno, "sink": ", ".join(hit), "severity": "MEDIUM"})
    return out


def enclosing_functions(source: str, lines: list[int]) -> list[tuple[int, str]]:
    """For each line the outermost function around it: (its first line, decorators included, its source)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    spans = [(min([f.lineno, *(d.lineno for d in f.decorator_list)]), f.end_lineno) for f in ast.walk(tree) if isinstance(f, DEFS)]
    text, out = source.split("\n"), []
    for n in lines:
        around = [s for s in spans if s[0] <= n <= s[1]]
        if around:
            start, end = min(around)
            out.append((start, "\n".join(text[start - 1 : end])))
    return list(dict.fromkeys(out))
