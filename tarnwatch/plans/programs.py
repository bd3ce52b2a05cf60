"""Programs for the parsers, one set per user of events, and what must be found in them, worked out by hand from the rules.

``{}`` stands for the user's number.  The expected rows name the program by its place in PROGRAMS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .duck import q

PROGRAMS = [
    (".py", '''import os, subprocess, requests
from flask import Flask

@server.tool()
def tool_{}(cmd, path):
    c = cmd
    os.system(c)
    helper_{}(path)
    cursor.execute("select " + path)

def helper_{}(p, **kw):
    open(p)
    subprocess.run(p, shell=True)

@app.get("/events")
def events_{}(request: Request):
    return Response(gen(), mimetype="text/event-stream")

@app.post("/messages")
def messages_{}(token):
    session_id = request.args.get("session_id")
    return requests.get(session_id)
'''),
    (".js", """const cp = require('child_process');
server.tool("run_{}", async ({ cmd, dir }) => {
  const full = `${cmd} ${dir}`; // exec(x)
  cp.exec(full);
  return load_{}(dir);
});
function load_{}(p) { return fs.readFile(p); }
const other_{} = async (q) => { db.query("select " + q); };
"""),
    (".py", '''@server.call_tool()
async def call_{}(name, arguments):
    if name == "run":
        return os.popen(arguments["cmd"])
    return eval(name)
'''),
    (".py", '''class Box_{}:
    def run_{}(self, data):
        def inner_{}(x):
            return pickle.loads(x)
        yaml.load(data)
        yaml.load(data, Loader=SafeLoader)
        return inner_{}(data)
'''),
    (".py", '''@mcp.tool()
def spread_{}(opts, url):
    target_{}(**opts)
    named_{}(where=url)
    requests.Session().get(url)
    urllib.request.urlopen(url)

def target_{}(a, b):
    shutil.rmtree(b)

def named_{}(what, where):
    httpx.get(where)
    exec(what)
'''),
    (".py", '''async def handle_{}(req: Request, password):
    name = "x"
    db.execute(f"select {name}")
    rows = session.filter(req)
    return validate(rows)
'''),
    (".py", "def broken_{}(:\n    eval(x)\n"),
    (".py", '''@login_required
@app.route("/stream")
def feed_{}(api_key):
    yield "data: x"

@app.post("/message")
def post_{}(secret):
    sid = request.args.get("session_id")
    return current_user.send(sid)
'''),
    (".py", '''@s.tool()
def top_{}(x):
    left_{}(x)
    right_{}(x)

def left_{}(x):
    deep_{}(x)

def right_{}(x):
    deep_{}(x)
    top_{}(x)

def deep_{}(x):
    return compile(x, "f", "exec")
'''),
    (".py", '''@s.tool()
def flow_{}(a, b):
    x, *y = b
    z = 1
    z += x
    os.remove(z)
    subprocess.Popen(y)
    marshal.loads(b"q")
'''),
    (".py", '''eval("1")
go_{} = lambda v: os.system(v)
def quiet_{}():
    return 1
'''),
    (".js", """const build_{} = code => { return new Function(code); };
async function shell_{}(name, ...rest) {
  child_process.exec(`ls ${name}`);
  execSync("ls");
  eval(rest);
}
"""),
    (".js", """export function load_x{}({ path, mode = "r" }, cb) {
  fs.readFile(path, cb);
  axios.get("https://a/" + path);
  if (mode) { run_x{}(path); }
}
const run_x{} = function (q) {
  return db.run(q);
};
"""),
    (".py", '''def ask_{}(token):
    return check_token(token)

def deep_chain_{}(u):
    return a.b.c(u)[0].d(u)

def many_{}(a, b=1, *rest, c=2, **more):
    return os.spawnl(a), os.system(c), open(rest)
'''),
    (".js", """server.addTool({
  name: "fetch_{}",
  description: "reads a page",
  execute: async (args) => {
    const url = args.url;
    return axios.get(url);
  },
});
"""),
    (".js", """server.setRequestHandler(types.CallToolRequestSchema, async (request) => {
  const { name, arguments: args } = request.params;
  if (name === "run") { return child_process.execSync(`sh ${args.cmd}`); }
});
"""),
    (".js", """const NAMES_{} = { first_{}: "a" };
server.tool(NAMES_{}.first_{}, async ({ cmd }) => {
  cp.exec(`ls ${f_{}({ a: cmd })}`);
});
server.tool({ name: SECOND_{}, schema }, async ({ path }) => {
  fs.readFile(path);
});
this.tool(name, (q) => db.query(q));
"""),
    (".js", """async function tpl_{}(dir, user) {
  const re = /["'`{(]/;
  cp.exec(`cat ${dir ? `${dir}/x` : "y"} > z`);
  if (re.test(user)) { eval(`"${user}"`); }
  return `}` + half_{}(user / 2 / 3);
}
"""),
    (".js", """app.get("/feed", (req, res) => {
  res.setHeader("Content-Type", "text/event-stream");
});
app.post("/messages", (req, res) => {
  const id = req.query.session_id;
  res.send(id);
});
"""),
    (".js", """server.tool("walk_{}", schema, async ({ list, cmd }) => {
  list.forEach((item) => {
    cp.exec(cmd + item);
  });
  helper_js_{}(cmd);
  helper_js_{}(list);
});
function helper_js_{}(v) { return eval(v); }
"""),
    (".js", """server.addTool({ name: 'method_{}', async execute({ q }) { return pool.query(`select ${q}`); } });
"""),
    (".js", """server.tool("cut_{}", async ({ x }) => {
  eval(x);
"""),
    (".ts", """export const typed_{}: Handler = async (a: string, b?: number): Promise<void> => {
  execSync(a);
};
function generic_{}<T>(v: T): string { return fetch(v); }
"""),
    (".py", '''@s.tool()
def twice_{}(x, y):
    same_{}(x)
    same_{}(y)
    same_{}(1)

def same_{}(v):
    os.system(v)
'''),
]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs of every user of events: (repo, file, content).

    The users are a few bytes each, so adaptive execution puts them into one task; they are dealt out anew, as each stands for files to be parsed.
    A key would not do that: the exchange before has it already, so Spark leaves out the second one.
    """
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u = u.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.col("user_id").cast("string")
    each = F.array(*[F.struct(F.concat(F.lit("src/p"), n, F.lit(f"_{k}{end}")).alias("file"), F.replace(F.lit(text), F.lit("{}"), n).alias("content")) for k, (end, text) in enumerate(PROGRAMS)])
    return u.select(F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repo"), F.inline(each))


#: program, name, first and last line, parameters, calls, tool, HTTP handler
FUNCTIONS = [
    (0, "tool_{}", 5, 9, 2, 3, True, False), (0, "helper_{}", 11, 13, 1, 2, False, False), (0, "events_{}", 16, 17, 1, 2, False, True), (0, "messages_{}", 20, 22, 1, 2, False, True),
    (1, "tool__run_{}", 2, 6, 2, 2, True, False), (1, "load_{}", 7, 7, 1, 1, False, False), (1, "other_{}", 8, 8, 1, 1, False, False),
    (2, "call_{}", 2, 5, 2, 2, False, False),
    (3, "run_{}", 2, 7, 1, 3, False, False), (3, "inner_{}", 3, 4, 1, 1, False, False),
    (4, "spread_{}", 2, 6, 2, 5, True, False), (4, "target_{}", 8, 9, 2, 1, False, False), (4, "named_{}", 11, 13, 2, 2, False, False),
    (5, "handle_{}", 1, 5, 2, 3, False, True),
    (7, "feed_{}", 3, 4, 1, 0, False, True), (7, "post_{}", 7, 9, 1, 2, False, True),
    (8, "top_{}", 2, 4, 1, 2, True, False), (8, "left_{}", 6, 7, 1, 1, False, False), (8, "right_{}", 9, 11, 1, 2, False, False), (8, "deep_{}", 13, 14, 1, 1, False, False),
    (9, "flow_{}", 2, 8, 2, 3, True, False),
    (10, "quiet_{}", 3, 4, 0, 0, False, False),
    (11, "build_{}", 1, 1, 1, 1, False, False), (11, "shell_{}", 2, 6, 2, 3, False, False),
    (12, "load_x{}", 1, 5, 3, 3, False, False), (12, "run_x{}", 6, 8, 1, 1, False, False),
    (13, "ask_{}", 1, 2, 1, 1, False, False), (13, "deep_chain_{}", 4, 5, 1, 2, False, False), (13, "many_{}", 7, 8, 2, 3, False, False),
    (14, "tool__fetch_{}", 1, 7, 1, 1, True, False), (15, "call_tool_handler", 1, 4, 1, 1, False, False),
    (16, "tool__first_{}", 2, 4, 1, 2, True, False), (16, "tool__SECOND_{}", 5, 7, 1, 1, True, False), (16, "tool__name_L8", 8, 8, 1, 1, True, False),
    (17, "tpl_{}", 1, 6, 2, 4, False, False), (19, "tool__walk_{}", 1, 7, 2, 4, True, False), (19, "helper_js_{}", 8, 8, 1, 1, False, False),
    (20, "tool__method_{}", 1, 1, 1, 1, True, False), (21, "tool__cut_{}", 1, 3, 1, 1, True, False), (22, "typed_{}", 1, 3, 2, 1, False, False), (22, "generic_{}", 4, 4, 1, 1, False, False),
    (23, "twice_{}", 2, 5, 2, 3, True, False), (23, "same_{}", 7, 8, 1, 1, False, False),
]
#: program, function, its line, type, expression, severity, line, influenced names, note
SINKS = [
    (0, "tool_{}", 5, "COMMAND", "os.system", "HIGH", 7, "c", ""), (0, "tool_{}", 5, "SQL", "cursor.execute", "HIGH", 9, "path", "dynamic SQL construction"),
    (0, "helper_{}", 11, "FILE", "open", "MEDIUM", 12, "p", ""), (0, "helper_{}", 11, "COMMAND", "subprocess.run", "HIGH", 13, "p", "shell=True — CRITICAL"),
    (0, "messages_{}", 20, "SSRF", "requests.get", "MEDIUM", 22, "", ""),
    (1, "tool__run_{}", 2, "COMMAND", "cp.exec", "HIGH", 4, "full", ""), (1, "load_{}", 7, "FILE", "fs.readFile", "MEDIUM", 7, "p", ""), (1, "other_{}", 8, "SQL", "db.query", "HIGH", 8, "q", ""),
    (2, "call_{}", 2, "COMMAND", "os.popen", "HIGH", 4, "arguments", ""), (2, "call_{}", 2, "EXEC", "eval", "HIGH", 5, "name", ""),
    (3, "run_{}", 2, "DESER", "yaml.load", "HIGH", 5, "data", ""), (3, "run_{}", 2, "DESER", "yaml.load", "HIGH", 6, "data", ""), (3, "inner_{}", 3, "DESER", "pickle.loads", "HIGH", 4, "x", ""),
    (4, "spread_{}", 2, "SSRF", "urllib.request.urlopen", "MEDIUM", 6, "url", ""), (4, "target_{}", 8, "FILE", "shutil.rmtree", "MEDIUM", 9, "b", ""),
    (4, "named_{}", 11, "SSRF", "httpx.get", "MEDIUM", 12, "where", ""), (4, "named_{}", 11, "EXEC", "exec", "HIGH", 13, "what", ""),
    (5, "handle_{}", 1, "SQL", "db.execute", "HIGH", 3, "", "dynamic SQL construction"), (5, "handle_{}", 1, "SQL", "session.filter", "HIGH", 4, "req", ""),
    (8, "deep_{}", 13, "EXEC", "compile", "HIGH", 14, "x", ""),
    (9, "flow_{}", 2, "FILE", "os.remove", "MEDIUM", 6, "z", ""), (9, "flow_{}", 2, "COMMAND", "subprocess.Popen", "HIGH", 7, "y", ""), (9, "flow_{}", 2, "DESER", "marshal.loads", "HIGH", 8, "", ""),
    (11, "build_{}", 1, "EXEC", "new Function", "HIGH", 1, "code", "dynamic code construction"), (11, "shell_{}", 2, "COMMAND", "child_process.exec", "HIGH", 3, "name", "template literal injection — CRITICAL"), (11, "shell_{}", 2, "EXEC", "eval", "HIGH", 5, "rest", ""),
    (12, "load_x{}", 1, "FILE", "fs.readFile", "MEDIUM", 2, "cb,path", ""), (12, "load_x{}", 1, "SSRF", "axios.get", "MEDIUM", 3, "path", ""), (12, "run_x{}", 6, "SQL", "db.run", "HIGH", 7, "q", ""),
    (13, "many_{}", 7, "COMMAND", "os.spawnl", "HIGH", 8, "a", ""), (13, "many_{}", 7, "COMMAND", "os.system", "HIGH", 8, "", ""), (13, "many_{}", 7, "FILE", "open", "MEDIUM", 8, "", ""),
    (14, "tool__fetch_{}", 1, "SSRF", "axios.get", "MEDIUM", 6, "url", ""), (15, "call_tool_handler", 1, "COMMAND", "child_process.execSync", "HIGH", 3, "args", "template literal injection — CRITICAL"),
    (16, "tool__first_{}", 2, "COMMAND", "cp.exec", "HIGH", 3, "cmd", ""), (16, "tool__SECOND_{}", 5, "FILE", "fs.readFile", "MEDIUM", 6, "path", ""), (16, "tool__name_L8", 8, "SQL", "db.query", "HIGH", 8, "q", ""),
    (17, "tpl_{}", 1, "COMMAND", "cp.exec", "HIGH", 3, "dir", "template literal injection — CRITICAL"), (17, "tpl_{}", 1, "EXEC", "eval", "HIGH", 4, "user", ""),
    (19, "tool__walk_{}", 1, "COMMAND", "cp.exec", "HIGH", 3, "cmd", ""), (19, "helper_js_{}", 8, "EXEC", "eval", "HIGH", 8, "v", ""), (20, "tool__method_{}", 1, "SQL", "pool.query", "HIGH", 1, "q", "dynamic SQL construction"),
    (21, "tool__cut_{}", 1, "EXEC", "eval", "HIGH", 2, "x", ""), (22, "typed_{}", 1, "COMMAND", "execSync", "HIGH", 2, "a", ""), (22, "generic_{}", 4, "SSRF", "fetch", "MEDIUM", 4, "v", ""), (23, "same_{}", 7, "COMMAND", "os.system", "HIGH", 8, "v", ""),
]
#: entry point, sinks that its parameters reach: an alias is not tracked, a diamond and two calls of one function count twice, a spread reaches all parameters
FLOWS = [
    ("tool_{}", 3), ("tool__run_{}", 1), ("call_{}", 1), ("spread_{}", 3), ("top_{}", 2), ("flow_{}", 1), ("tool__fetch_{}", 0), ("call_tool_handler", 0), ("tool__first_{}", 1), ("tool__SECOND_{}", 1), ("tool__name_L8", 1),
    ("tool__walk_{}", 3), ("tool__method_{}", 1), ("tool__cut_{}", 1), ("twice_{}", 2),
]
#: caller, callee of calls by bare names
EDGES = [
    ("tool_{}", "helper_{}"), ("helper_{}", "open"), ("events_{}", "Response"), ("events_{}", "gen"), ("call_{}", "eval"), ("run_{}", "inner_{}"), ("spread_{}", "target_{}"), ("spread_{}", "named_{}"), ("named_{}", "exec"), ("handle_{}", "validate"),
    ("top_{}", "left_{}"), ("top_{}", "right_{}"), ("left_{}", "deep_{}"), ("right_{}", "deep_{}"), ("right_{}", "top_{}"), ("deep_{}", "compile"), ("ask_{}", "check_token"), ("many_{}", "open"), ("twice_{}", "same_{}"),
]
#: program, call, line
RISKY = [
    (0, "os.system", 7), (0, "open", 12), (0, "subprocess.run", 13), (0, "requests.get", 22), (2, "os.popen", 4), (2, "eval", 5), (4, "exec", 13), (9, "subprocess.Popen", 7), (10, "eval", 1), (10, "os.system", 2), (13, "os.system", 8), (13, "open", 8), (23, "os.system", 8),
]
#: program, type, function, line, sink
TAINTS = [
    (0, "INTERPROCEDURAL", "tool_{}", 8, "helper_{}"), (0, "SQL_INJECTION", "tool_{}", 9, "execute"), (0, "TAINTED_SINK", "helper_{}", 12, "open"), (0, "TAINTED_SINK", "helper_{}", 13, "subprocess.run"),
    (2, "TAINTED_SINK", "call_{}", 4, "os.popen"), (2, "TAINTED_SINK", "call_{}", 5, "eval"),
    (3, "TAINTED_SINK", "run_{}", 5, "yaml.load"), (3, "INTERPROCEDURAL", "run_{}", 7, "inner_{}"), (3, "TAINTED_SINK", "inner_{}", 4, "pickle.loads"),
    (4, "TAINTED_SINK", "named_{}", 13, "exec"), (5, "SQL_INJECTION", "handle_{}", 3, "execute"),
    (8, "INTERPROCEDURAL", "left_{}", 7, "deep_{}"), (8, "INTERPROCEDURAL", "right_{}", 10, "deep_{}"), (8, "TAINTED_SINK", "deep_{}", 14, "compile"),
    (13, "TAINTED_SINK", "many_{}", 8, "os.spawnl"), (23, "INTERPROCEDURAL", "twice_{}", 3, "same_{}"), (23, "INTERPROCEDURAL", "twice_{}", 4, "same_{}"), (23, "TAINTED_SINK", "same_{}", 8, "os.system"),
]
#: program, function, line, credential parameters of functions that never validate
AUTH = [(0, "messages_{}", 20, "token"), (7, "feed_{}", 3, "api_key"), (7, "post_{}", 7, "secret")]


def expected(rows: list[tuple], names: list[str], select: str) -> str:
    """DuckDB SQL: rows for every user; in select, n is the user's number, repo its repository, and text may hold ``{}``."""

    def lit(x: object) -> str:
        return q(x) if isinstance(x, str) else str(x).lower()

    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"WITH u AS (SELECT DISTINCT user_id AS n, 'repo' || (user_id % 5) AS repo FROM events), e({', '.join(names)}) AS (VALUES {values}) SELECT {select} FROM u, e"


def text(column: str) -> str:
    return f"replace({column}, '{{}}', n::VARCHAR)"


ENDS = "[" + ", ".join(q(end) for end, _ in PROGRAMS) + "]"
FILE = f"'src/p' || n || '_' || k || {ENDS}[k + 1] AS file"
_functions = ["k", "name", "line_start", "line_end", "n_params", "n_calls", "is_tool", "is_http"]
_found = f"repo, {FILE}, {text('name')} AS name, line_start, line_end, n_params, n_calls, is_tool"
INDEX_PY = expected([r for r in FUNCTIONS if PROGRAMS[r[0]][0] == ".py"], _functions, _found + ", is_http")
INDEX_JS = expected([r for r in FUNCTIONS if PROGRAMS[r[0]][0] != ".py"], _functions, _found)
PARSED_SINKS = expected(SINKS, ["k", "func", "func_line", "sink_type", "sink_expr", "severity", "line", "influenced", "note"], f"repo, {FILE}, {text('func')} AS func, func_line, sink_type, sink_expr, severity, line, influenced, note")
FLOW_COUNTS = expected(FLOWS, ["root", "n_sinks"], f"repo || '/' || {text('root')} AS root, n_sinks AS n")
CALL_GRAPH = expected(EDGES, ["src", "dst"], f"DISTINCT repo, {text('src')} AS src, {text('dst')} AS dst")
RISKY_CALLS = expected(RISKY, ["k", "call", "line"], f"repo, {FILE}, call, line")
TAINT_V2 = expected(TAINTS, ["k", "type", "func", "line", "sink"], f"repo, {FILE}, type, {text('func')} AS func, line, {text('sink')} AS sink, 'HIGH' AS severity")
AUTH_PARAMS = expected(AUTH, ["k", "func", "line", "sink"], f"repo, {FILE}, 'UNVALIDATED_AUTH_PARAM' AS type, {text('func')} AS func, line, sink, 'MEDIUM' AS severity")
SSE_NO_AUTH = expected([(0, 15), (18, 1)], ["k", "line"], f"repo, {FILE}, line, 'SSE_NO_AUTH' AS type, 'HIGH' AS severity")
MESSAGES = expected([(0, 19), (18, 1)], ["k", "line"], f"repo, {FILE}, line, 'MCP_MESSAGES_NO_SESSION_BIND' AS type, 'MEDIUM' AS severity, 'POST /messages' AS match")
#: A reply is cut after 70 characters, no JSON at all, or whole; a cut one keeps its first verdict.
REPLY_CHECKS = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'truncated; ' || CASE WHEN doc_id % 3 = 0 THEN 'canary mismatch; ' ELSE '' END || 'only 1/2 verdicts'
WHEN doc_id % 7 = 0 THEN 'malformed' ELSE array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'canary mismatch' END, CASE WHEN doc_id % 2 = 0 THEN 'all dismissed' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM documents"""
