"""Registered queries of the call-graph operators over a graph made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import structure
from ..operators import trace as T
from ..sources.corpus import pick
from .duck import listed, q

PARAMS = ["a", "b", "c"]
DOTTED = ["os.system", "subprocess.run", "cursor.execute", "re.compile", "urllib.request.urlopen", "x.open", "requests.get", "print", "db.filter", "yaml.safe_load"]
KINDS = ["COMMAND", "EXEC", "FILE", "SSRF"]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    n = p.agg(F.count("*").alias("n"))
    p = p.crossJoin(F.broadcast(n))  # one row
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    call_tool = F.col("k") % 50 == 0
    params = F.when(call_tool, F.array(F.lit("name"), F.lit("arguments"))).otherwise(F.slice(F.array(*map(F.lit, PARAMS)), 1, (F.col("s") % 3 + 1).cast("int")))
    functions = p.select(name(F.col("k")).alias("name"), params.alias("params"), (F.col("k") % 10 == 1).alias("is_tool"), call_tool.alias("is_call_tool"), (F.col("k") % 8 == 3).alias("is_http"))
    first = F.struct(F.lit(1).alias("line"), name((F.col("k") * 7 + 3) % F.col("n") + 1).alias("callee"), F.array(F.array(F.lit("a")), F.when(F.col("k") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))).alias("pos"), (F.col("k") % 11 == 0).alias("star"))
    second = F.struct(F.lit(2).alias("line"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("ext"), (F.col("k") % 5).cast("string"))).otherwise(name((F.col("k") * 11 + 5) % F.col("n") + 1)).alias("callee"), F.array(F.when(F.col("k") % 4 == 0, F.array(F.lit("arguments"))).otherwise(F.array(F.lit("c")))).alias("pos"), F.lit(False).alias("star"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    calls = p.select(name(F.col("k")).alias("func"), F.inline(F.array(first, second))).withColumn("kw", empty)
    influenced = F.when(F.col("k") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(pick([*PARAMS, "arguments"], F.col("k"))))
    sinks = p.where("k % 3 <> 1").select(name(F.col("k")).alias("func"), F.lit(3).alias("line"), pick(KINDS, F.col("s")).alias("sink_type"), influenced.alias("influenced"))
    return functions, calls, sinks


GRAPH_SQL = f"""p AS (SELECT p_partkey AS k, p_size::BIGINT AS s, (SELECT count(*) FROM part) AS n FROM part),
functions AS (SELECT 'f' || k AS name, CASE WHEN k % 50 = 0 THEN ['name', 'arguments'] ELSE {listed(PARAMS)}[1:(s % 3 + 1)] END AS params, k % 10 = 1 AS is_tool, k % 50 = 0 AS is_call_tool, k % 8 = 3 AS is_http FROM p),
calls AS (SELECT 'f' || k AS func, 1 AS line, 'f' || ((k * 7 + 3) % n + 1) AS callee, [['a'], CASE WHEN k % 2 = 0 THEN ['b', 'c'] ELSE [] END] AS pos, k % 11 = 0 AS star FROM p
  UNION ALL SELECT 'f' || k, 2, CASE WHEN k % 3 = 0 THEN 'ext' || (k % 5) ELSE 'f' || ((k * 11 + 5) % n + 1) END, [CASE WHEN k % 4 = 0 THEN ['arguments'] ELSE ['c'] END], false FROM p),
sinks AS (SELECT 'f' || k AS func, 3 AS line, {listed(KINDS)}[s % 4 + 1] AS sink_type, CASE WHEN k % 5 = 0 THEN [] ELSE [{listed([*PARAMS, 'arguments'])}[k % 4 + 1]] END AS influenced FROM p WHERE k % 3 <> 1),
joined AS (SELECT c.*, f.params AS cp FROM calls c LEFT JOIN functions f ON f.name = c.callee),
nodes AS (
  SELECT name AS root, [name] AS path, 0 AS depth, name AS func, CASE WHEN is_call_tool AND list_contains(params, 'arguments') THEN ['arguments'] ELSE params END AS tracked FROM functions WHERE is_tool OR is_call_tool
  UNION ALL
  SELECT root, list_append(path, callee), depth + 1, callee, CASE WHEN len(new) > 0 THEN new ELSE tracked END FROM (
    SELECT n.*, j.callee, j.cp, list_has_any(flatten(j.pos), n.tracked) OR j.star AS carries,
           CASE WHEN j.star THEN j.cp ELSE list_filter([CASE WHEN list_has_any(j.pos[1], n.tracked) THEN j.cp[1] END, CASE WHEN list_has_any(j.pos[2], n.tracked) THEN j.cp[2] END], lambda x: x IS NOT NULL) END AS new
    FROM nodes n JOIN joined j ON j.func = n.func WHERE n.depth < 4 AND j.cp IS NOT NULL AND NOT list_contains(n.path, j.callee)) WHERE len(new) > 0 OR carries
)"""
_head = f"WITH RECURSIVE {GRAPH_SQL}"
PATH = "array_to_string(path, '>') AS path"


def _nodes(s: SparkSession, d: str, pick_out: str = "nodes") -> DataFrame:
    functions, calls, sinks = graph(s, d)
    nodes, leaves = T.trace(functions, calls)
    joined = F.array_join("path", ">").alias("path")
    if pick_out == "nodes":
        return nodes.select("root", joined, "depth", "func", F.array_join(F.array_sort("tracked"), ",").alias("tracked"))
    if pick_out == "leaves":
        return leaves.select("root", joined, "depth", "callee", "line")
    if pick_out == "sinks":
        return T.reached_sinks(nodes, sinks).select("root", joined, "depth", "func", "line", "sink_type")
    return T.sink_counts(nodes, sinks)


def _calls(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), pick(DOTTED, F.col("p_partkey")).alias("dotted"))


def sink_catalogue(spark: SparkSession, sinks: dict = catalog.SINKS_PY) -> DataFrame:
    rows = [(t, severity, module, f) for t, (severity, modules) in sinks.items() for module, names in modules.items() for f in names]
    return spark.createDataFrame(rows, "sink_type string, severity string, module string, function string")


def _sql_calls(s: SparkSession, d: str) -> DataFrame:
    """SQL sinks among all calls: of three calls one has neither a tainted nor a built argument, one a built and one a tainted argument."""
    kind = F.col("id") % 3
    tainted = F.when(kind == 2, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    calls = _calls(s, d).select(
        F.lit("r").alias("repo"), F.lit("src/calls.py").alias("file"), F.col("id").cast("string").alias("func"), F.lit(1).alias("func_line"), F.lit(2).alias("line"),
        F.substring_index("dotted", ".", -1).alias("callee"), "dotted", tainted.alias("influenced"), F.lit(False).alias("shell"), (kind == 1).alias("dynamic"),
    )
    found = structure.sinks_of(calls, sink_catalogue(s), sink_catalogue(s, catalog.SINKS_JS)).where("sink_type = 'SQL'")
    return found.select(F.col("func").cast("long").alias("id"), F.col("sink_expr").alias("dotted"), "sink_type", "note")


def _assignments(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = lambda x: F.concat(F.lit("v"), x.cast("string"))
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"))
    func = F.concat(F.lit("g"), F.floor(F.col("k") / 20).cast("string")).alias("func")
    return p.select(func, v(F.col("k") % 7 + F.col("k") % 3).alias("target"), v(F.col("k") % 5).alias("source")), p.where("k % 20 = 0").select(func, v(F.col("k") % 4).alias("name"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    _, calls, _ = graph(s, d)
    return calls.select(F.col("func").alias("src"), F.col("callee").alias("dst")).unionByName(calls.where("line = 1").select(F.col("func").alias("src"), F.col("callee").alias("dst"))).distinct()


_catalogue = "\nUNION ALL ".join(f"SELECT {q(t)} AS sink_type, {q(sev)} AS severity, {q(m)} AS module, unnest({listed(names)}) AS function" for t, (sev, mods) in catalog.SINKS_PY.items() for m, names in mods.items())
_dotted = f"(SELECT p_partkey AS id, {listed(DOTTED)}[p_partkey % {len(DOTTED)} + 1] AS dotted FROM part)"
_last = "string_split(dotted, '.')[-1]"

QUERIES = {
    "trace_paths": (_nodes, f"{_head} SELECT root, {PATH}, depth, func, array_to_string(list_sort(tracked), ',') AS tracked FROM nodes"),
    "trace_external": (lambda s, d: _nodes(s, d, "leaves"), f"{_head} SELECT n.root, array_to_string(n.path, '>') AS path, n.depth + 1 AS depth, j.callee, j.line FROM nodes n JOIN joined j ON j.func = n.func WHERE n.depth < 4 AND j.cp IS NULL AND (list_has_any(flatten(j.pos), n.tracked) OR j.star)"),
    "trace_sinks": (lambda s, d: _nodes(s, d, "sinks"), f"{_head} SELECT n.root, {PATH}, depth, n.func, s.line, sink_type FROM nodes n JOIN sinks s ON s.func = n.func WHERE len(influenced) = 0 OR list_has_any(influenced, tracked)"),
    "trace_counts": (lambda s, d: _nodes(s, d, "counts"), f"{_head} SELECT e.root, count(s.func) AS n FROM (SELECT root FROM nodes WHERE depth = 0) e LEFT JOIN nodes n ON n.root = e.root LEFT JOIN sinks s ON s.func = n.func AND (len(influenced) = 0 OR list_has_any(influenced, tracked)) GROUP BY e.root"),
    "http_handlers": (lambda s, d: T.http_findings(*graph(s, d)), f"{_head} SELECT name AS handler, s.func AS via, s.line, sink_type FROM functions f JOIN sinks s ON s.func = f.name WHERE is_http UNION ALL SELECT name, s.func, s.line, sink_type FROM functions f JOIN calls c ON c.func = f.name JOIN sinks s ON s.func = c.callee WHERE is_http"),
    "sink_join": (lambda s, d: T.match_sinks(_calls(s, d), sink_catalogue(s)), f"SELECT DISTINCT id, dotted, sink_type, severity FROM {_dotted} c JOIN ({_catalogue}) k ON {_last} = function AND (module = '' OR dotted = module || '.' || function OR starts_with(dotted, module || '.'))"),
    "sql_sinks": (_sql_calls, f"SELECT id, dotted, 'SQL' AS sink_type, CASE WHEN id % 3 = 1 THEN 'dynamic SQL construction' ELSE '' END AS note FROM {_dotted} WHERE list_contains({listed(catalog.SQL_METHODS_PY)}, {_last}) AND id % 3 <> 0"),
    "taint_closure": (lambda s, d: T.taint_closure(*_assignments(s, d)), "WITH RECURSIVE a AS (SELECT 'g' || (p_partkey // 20) AS func, 'v' || (p_partkey % 7 + p_partkey % 3) AS target, 'v' || (p_partkey % 5) AS source FROM part), t AS (SELECT 'g' || (p_partkey // 20) AS func, 'v' || (p_partkey % 4) AS name FROM part WHERE p_partkey % 20 = 0 UNION SELECT a.func, a.target FROM t JOIN a ON a.func = t.func AND a.source = t.name) SELECT func, name FROM t"),
    "call_edges": (_edges, f"{_head} SELECT DISTINCT func AS src, callee AS dst FROM calls"),
}
