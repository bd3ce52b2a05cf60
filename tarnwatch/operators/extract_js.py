"""JavaScript and TypeScript source -> the same function records.

``lex`` reads a file once with a stack of templates: strings, comments and regular expressions are blanked at equal length, the expressions in templates (nested as they may be) stay as code, and every bracket gets its
partner.  Calls, assignments, functions and names are listed once per file, in order; a function takes what lies between its brackets by bisection, so nested and broken files cost no more than their size and what is found.

A bracket without a partner (a broken file) ends early: arguments with their line, a body where the next function or tool begins, and an unclosed registration takes the first function after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
KEYWORDS = frozenset("if for while switch catch return function await new typeof throw async of in do else super import".split())
#: Words after which a slash opens a regular expression; after other words, numbers and closing brackets it divides.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
TOKEN = re.compile(rf"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|{IDENT}|\d[\w.]*|\S""", re.DOTALL)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
HOLE_MARK = "\x02"  # stands before the expressions of a template
CLOSERS = {")": "(", "]": "[", "}": "{"}
NAME = re.compile(rf"(?<![.\w$]){IDENT}")
SPREAD = re.compile(rf"\.\.\.\s*({IDENT})")
HOLE = re.compile(rf"{HOLE_MARK}\s*({IDENT})")
CHAIN = re.compile(rf"(?<![\w$]){IDENT}(?:\s*\??\.\s*{IDENT})*+")
ASSIGN = re.compile(rf"(?<![\w$])(\{{[^{{}}]*\}}|\[[^\[\]]*\]|{IDENT})\s*(?::\s*[\w$.<>\[\]|&, ]+)?(?:[-+*/%&|^]|\?\?|\|\||&&|<<|>>>?)?=(?![=>])")
FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*(?:{IDENT})?\s*(?:<[^<>(){{}}]*>\s*)?\(|\(|(?<![\w$.])({IDENT})\s*=>")
DECLARES = re.compile(r"\bfunction\s*\*?\s+$|\bfunction\s*\*\s*$")
NAMED = re.compile(rf"\bfunction\s*\*?\s+({IDENT})\s*(?:<[^<>(){{}}]*>\s*)?\(|\b(?:const|let|var)\s+({IDENT})\s*(?::[^=:;\n(){{}}]*)?=\s*(?:async\s+)?(?:function\b\s*\*?\s*(?:{IDENT})?\s*\(|\(|{IDENT}\s*=>)")
TOOL = re.compile(r"\.\s*tool\s*\(|\baddTool\s*\(|\bsetRequestHandler\s*\(\s*(?:\w+\s*\.\s*)*CallToolRequestSchema\b")
EXECUTE = re.compile(r"\bexecute\s*(:|\()")
STOP = re.compile(r"[()\[\]{};,\n]")
SPACE = re.compile(r"\s*")
#: A first argument of these names says nothing about the tool.
GENERIC = frozenset(["name", "toolName", "tool", "unknown"])


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def lex(source: str) -> tuple[str, str, dict[int, int]]:
    """(code, text, partners): source with comments, strings and regular expressions blanked, source with comments blanked, and the closing bracket of each opening one.  Offsets and lines stay."""
    hidden: list[tuple[int, int, str, bool]] = []  # from, to, what code shows, whether it is a comment
    opened: dict[str, list[int]] = {"(": [], "[": [], "{": []}
    partners: dict[int, int] = {}
    holes: list[int] = []  # open braces in the expression of each template that is being read
    at, before, template = 0, "", None

    while at < len(source):
        if template is not None:  # start of template text that is not hidden yet
            m = IN_TEMPLATE.search(source, at)
            at = m.end() if m else len(source)
            if m and m[0][0] == "\\":
                continue
            expression = m is not None and m[0] == "${"
            hidden.append((template, at, blank(source[template : at - 2]) + f"{HOLE_MARK} " if expression else blank(source[template:at]), False))
            template, before = None, "{" if expression else ")"
            if expression:
                holes.append(0)
            continue
        m = TOKEN.search(source, at)
        if not m:
            break
        token, start, at = m[0], m.start(), m.end()
        first = token[0]
        if token.startswith(("//", "/*")):
            hidden.append((start, at, blank(token), True))
            continue
        if first == "`":
            template = start
            continue
        if first in "'\"":
            hidden.append((start, at, blank(token), False))
        elif first == "/" and (before in BEFORE_REGEX or not re.match(r"[\w$)\]<]", before[-1:] or "=")) and (m := REGEX.match(source, start)):
            at = m.end()
            hidden.append((start, at, blank(m[0]), False))
            first = ")"
        elif first in opened:
            opened[first].append(start)
            if first == "{" and holes:
                holes[-1] += 1
        elif first in CLOSERS:
            if first == "}" and holes:
                if not holes[-1]:  # the end of a template's expression
                    holes.pop()
                    template = start
                    continue
                holes[-1] -= 1
            if opened[CLOSERS[first]]:
                partners[opened[CLOSERS[first]].pop()] = start
        before = token if first.isalnum() or first in "_$" else ")" if first in "'\")" else first
    if template is not None:
        hidden.append((template, len(source), blank(source[template:]), False))

    def shown(comments_only: bool) -> str:
        out, last = [], 0
        for a, b, what, comment in hidden:
            if comment or not comments_only:
                out += [source[last:a], what]
                last = b
        return "".join(out) + source[last:]

    return shown(False), shown(True), partners


def split_top(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p for p in [*parts, text[last:]] if p.strip()]


def parameters(text: str) -> list[str]:
    """Names bound by a parameter list: plain, typed, defaulted, rest and destructured ones."""
    out = []
    for p in split_top(text):
        p = p.strip().removeprefix("...")
        if p[:1] and p[0] in "{[":
            inner = p[1 : max(p.rfind("}" if p[0] == "{" else "]"), 1)]
            for x in split_top(inner):
                x = x.strip().removeprefix("...")
                target = x.split(":", 1)[1].strip() if ":" in x.split("=", 1)[0] else x
                out += parameters(target) if target[:1] and target[0] in "{[" else [target.split("=", 1)[0].strip()]
        elif m := re.match(IDENT, p):
            out.append(m[0])
    return [p for p in out if re.fullmatch(IDENT, p)]


class Listing:
    """What a file holds, in order of place; built once."""

    def __init__(self, source: str) -> None:
        self.code, self.text, self.partners = lex(source)
        code = self.code
        self.newlines = [m.start() for m in re.finditer("\n", code)]
        self.ends = [m.start() for m in re.finditer("[;\n]", code)]
        self.marks = [m.start() for m in re.finditer(r"[={]", code)]
        words = [m for m in NAME.finditer(code) if m[0] not in KEYWORDS]
        self.name_at, self.names = [m.start() for m in words], [m[0] for m in words]
        self.spreads, self.holes, self.executes = ([m for m in p.finditer(code)] for p in (SPREAD, HOLE, EXECUTE))
        self.spread_at, self.hole_at, self.execute_at = ([m.start() for m in found] for found in (self.spreads, self.holes, self.executes))
        self.tools, self.named = list(TOOL.finditer(code)), list(NAMED.finditer(code))
        self.begins = sorted({m.start() for m in self.tools} | {m.start() for m in self.named})
        self.functions = list(self._functions())
        self.function_at = [f[0] for f in self.functions]
        self.calls = []
        for m in CHAIN.finditer(code):
            opened = SPACE.match(code, m.end()).end()
            if not code.startswith("(", opened):
                continue
            full = re.sub(r"\s|\?", "", m[0])
            if full.split(".")[0] not in KEYWORDS and not DECLARES.search(code, max(0, m.start() - 16), m.start()):
                if full == "Function" and re.search(r"\bnew\s+$", code[max(0, m.start() - 16) : m.start()]):
                    full = "new Function"
                self.calls.append((m.start(), full, opened))
        self.call_at = [c[0] for c in self.calls]
        self.assigned = [(m.start(), m.end(), m[1]) for m in ASSIGN.finditer(code)]
        self.assigned_at = [a[0] for a in self.assigned]

    def line(self, at: int) -> int:
        return bisect_left(self.newlines, at) + 1

    def after(self, places: list[int], at: int) -> int:
        """The first of places from at on, or the end of the file."""
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.code)

    def used(self, start: int, end: int) -> set[str]:
        """Variables between two places; property names after a dot are none."""
        return set(self.names[bisect_left(self.name_at, start) : bisect_left(self.name_at, end)])

    def block(self, opened: int) -> tuple[int, int]:
        """Where the body that opens there ends: at its partner, or before the line in which the next function or tool begins."""
        if opened in self.partners:
            return opened, self.partners[opened]
        begin = self.after(self.begins, opened + 1)
        k = bisect_left(self.newlines, begin)
        return opened, self.newlines[k - 1] if k and begin < len(self.code) and self.newlines[k - 1] > opened else begin

    def _functions(self):
        """(place, parameters, start of the body, whether it is a block) of arrows and function expressions."""
        code = self.code
        for m in FUNCTION.finditer(code):
            if m[1]:
                names, after = [m[1]], m.end()
            else:
                opened = m.end() - 1
                closed = self.partners.get(opened)
                if closed is None:
                    continue
                follows = SPACE.match(code, closed + 1).end()
                mark = self.after(self.marks, closed + 1)
                if mark != follows and code[follows : follows + 1] != ":":
                    continue  # neither an arrow, nor a block, nor a type follows
                if code.startswith("=>", mark):
                    after = mark + 2
                elif m[0] != "(" and code.startswith("{", mark):
                    after = mark
                else:
                    continue
                names = parameters(code[opened + 1 : closed])
            body = SPACE.match(code, after).end()
            yield m.start(), names, body, code.startswith("{", body)

    def expression_end(self, at: int, limit: int) -> int:
        """The end of the expression at a place: brackets are jumped over, a line ends it unless it goes on in the next."""
        start = at
        while m := STOP.search(self.code, at, limit):
            c, at = m[0], m.end()
            if c in "([{":
                at = self.partners.get(m.start(), self.after(self.newlines, at) - 1) + 1
            elif c != "\n":
                return m.start()
            elif self.code[start : m.start()].strip():
                following = SPACE.match(self.code, at).end()
                if self.code[following : following + 1] not in tuple(".?:+-*/%&|^=<>"):
                    return m.start()
        return limit

    def body(self, function: tuple, limit: int) -> tuple[list[str], int, int]:
        """(parameters, start, end) of a function."""
        _, names, start, is_block = function
        return names, *(self.block(start) if is_block else (start, self.expression_end(start, limit)))

    def callback(self, start: int, end: int, first: bool = False) -> tuple[list[str], int, int] | None:
        """The last function among the arguments between two places, or the first one; functions inside it are part of it."""
        best, at = None, start
        while (k := bisect_left(self.function_at, at)) < len(self.functions) and self.function_at[k] < end:
            best = self.body(self.functions[k], end)
            if first:
                break
            at = max(best[2], self.function_at[k] + 1)
        return best

    def record(self, name: str, params: list[str], start: int, end: int, line: int, **roles) -> dict:
        reaches: dict[str, set[str]] = {}
        for a, value, target in self.assigned[bisect_left(self.assigned_at, start) : bisect_left(self.assigned_at, end)]:
            targets = set(parameters(target)) if target[0] in "{[" else {target}
            for x in self.used(value, min(end, self.after(self.ends, value))):
                reaches.setdefault(x, set()).update(targets)
        known, todo = set(params), list(params)
        while todo:
            fresh = reaches.get(todo.pop(), set()) - known
            known |= fresh
            todo += fresh
        calls: dict[tuple, dict] = {}
        for at, full, opened in self.calls[bisect_left(self.call_at, start) : bisect_left(self.call_at, end)]:
            row_line = self.line(at)
            if (full, row_line) in calls:
                continue
            closed = self.partners.get(opened, self.after(self.newlines, opened))
            used = self.used(opened, closed)
            within = lambda places, found: {m[1] for m in found[bisect_right(places, opened) : bisect_left(places, closed)]}  # noqa: B023, E731
            calls[full, row_line] = {
                "callee": full.rsplit(".", 1)[-1], "dotted": full, "line": row_line, "pos": [sorted(used)], "kw": {}, "star": bool(within(self.spread_at, self.spreads) & known), "influenced": sorted(used & known),
                "shell": False, "dynamic": bool(within(self.hole_at, self.holes) & known),
            }
        return {"name": name, "line_start": line, "line_end": self.line(end), "params": [{"name": p, "annotation": ""} for p in params], "decorators": [], "is_tool": False, "is_call_tool": False, "is_http": False, "calls": list(calls.values())} | roles

    def tool_name(self, opened: int) -> str:
        """Of a registration: its literal name, or the last part of the constant that names it, with the line where that part says nothing."""
        text, at = self.text, SPACE.match(self.text, opened + 1).end()
        found = re.compile(r"(['\"`])((?:(?!\1|\$\{)[^\n])+)\1|([\w$.]+)").match(text, at)
        if text.startswith("{", at):
            found = re.compile(r"\bname\s*:\s*(?:(['\"`])((?:(?!\1|\$\{)[^\n])+)\1|([\w$.]+))").search(text, at, self.partners.get(at, self.after(self.newlines, at)))
        if found and found[2]:
            return found[2]
        last = found[3].rstrip(".").rsplit(".", 1)[-1] if found and found[3] else "unknown"
        return f"{last}_L{self.line(opened)}" if last in GENERIC else last


def index_js(source: str) -> list[dict]:
    """Records of tools and request handlers, then of functions with a name (the first one of each name)."""
    found, out = Listing(source), []
    for m in found.tools:
        opened = found.code.index("(", m.start())
        closed = found.partners.get(opened)
        end = closed if closed is not None else found.after(found.begins, opened)
        k = bisect_left(found.execute_at, opened)
        named = found.executes[k] if k < len(found.executes) and found.execute_at[k] < end else None
        if named and named[1] == "(" and named.end() - 1 in found.partners:  # a method of the object
            inner = found.partners[named.end() - 1]
            got = parameters(found.code[named.end() : inner]), *found.block(found.after(found.marks, inner))
        else:
            got = found.callback(named.end() if named else opened + 1, len(found.code) if closed is None else end, first=bool(named) or closed is None)
        if got:
            handler = "setRequestHandler" in m[0]
            name = "call_tool_handler" if handler else f"tool__{found.tool_name(opened)}"
            out.append(found.record(name, got[0] or ["request" if handler else "args"], got[1], got[2], found.line(m.start()), is_tool=not handler, is_call_tool=handler))
    names = set()
    for m in found.named:
        name = m[1] or m[2]
        k = bisect_left(found.function_at, m.start() if m[1] else m.start(2))
        if name not in names and k < len(found.functions) and found.function_at[k] < m.end():
            names.add(name)
            out.append(found.record(name, *found.body(found.functions[k], len(found.code)), found.line(m.start())))
    return out
