"""From function records to a flow report: traces whose nodes are call sites, drawn as trees, with heads, parameters, HTTP findings and a footer.

A node is one call on one path from an entry point: two calls of one function are two nodes, in the order of the caller's calls, and a name that several functions of a repository have leads to each of them.  A node's key lists
(number of the call, number of the function) from its entry down, so sorting by it is the order of the report.  Names are resolved once, in a join that spreads hot names; each level is one join on the function's
number and one window over the children of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from .trace import carried, mapped

FUNCTION = ["repo", "file", "func", "func_line"]
NODE = ["repo", "root", "key", "depth", "fid", "func", "file", "names", "tracked", "label", "line", "pad", "last"]
#: What a line of a report is sorted by: section, entry point, part of the section, node, and the rest within a node.
ORDER = ["section", "entry", "part", "key", "a", "b", "c"]


def numbered(functions: DataFrame) -> DataFrame:
    """functions (repo, file, func, func_line, params array<string>, is_tool, is_call_tool, is_http) with their number fid, in order of file, name and line: the order of the report."""
    return shared.cut(shared.ranked(functions, [F.col(c) for c in ("repo", "file", "func", "func_line")], "fid"))


def call_sites(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Numbered functions and calls (repo, file, func, func_line, call_no, line, callee, dotted, pos, kw, star) as edges, one per call and function of that name in the repository; target is null where none is."""
    own = functions.select(*FUNCTION, F.col("fid").alias("caller"))
    targets = functions.select("repo", F.col("func").alias("callee"), F.col("fid").alias("target"), F.col("file").alias("target_file"), F.col("params").alias("target_params"))
    sites = shared.cut(calls.join(own, FUNCTION).select("repo", "caller", "call_no", "line", "callee", "dotted", "pos", "kw", "star"))
    return shared.cut(shared.salted_join(sites, targets, ["repo", "callee"]).drop("repo"))


def trace(functions: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Nodes of all entry points, those of external calls (fid null) included: repo, root (the entry's fid), key, depth, fid, func, file, names, tracked, label, line, pad, last.

    A function on the path already is not entered again; one that no tracked name reaches is only entered, with the caller's names, if the call carries some.  pad is what stands before a node's children, last whether a node is its parent's last.
    """
    only = F.col("is_call_tool") & F.array_contains("params", "arguments")
    level = functions.where("is_tool OR is_call_tool").select(
        "repo", F.col("fid").alias("root"), F.array().cast("array<long>").alias("key"), F.lit(0).alias("depth"), "fid", "func", "file", F.array("func").alias("names"),
        F.when(only, F.array(F.lit("arguments"))).otherwise(F.col("params")).alias("tracked"), F.col("func").alias("label"), F.col("func_line").alias("line"), F.lit("").alias("pad"), F.lit(True).alias("last"),
    )
    nodes = level
    for k in range(1, depth + 1):
        step = level.where("fid IS NOT NULL").drop("line").join(edges, F.col("fid") == F.col("caller"))
        step = step.withColumn("carries", carried(F.col("tracked")))
        reached = mapped(F.col("tracked"), F.col("target_params"))
        new = F.when(F.col("target").isNotNull(), F.when(F.size(reached) > 0, reached).when(F.col("carries"), F.col("tracked"))).when(F.col("carries"), F.array().cast("array<string>"))
        step = step.withColumn("new", new).where(F.col("new").isNotNull() & (F.col("target").isNull() | ~F.array_contains("names", F.col("callee"))))
        children = Window.partitionBy("root", "key").orderBy("call_no", "target")
        step = step.withColumn("is_last", F.lead("call_no").over(children).isNull())
        level = shared.cut(step.select(
            "repo", "root", F.concat("key", F.array(F.col("call_no").cast("long"), F.coalesce("target", F.lit(0)))).alias("key"), F.lit(k).alias("depth"), F.col("target").alias("fid"), F.col("callee").alias("func"),
            F.col("target_file").alias("file"), F.array_append("names", F.col("callee")).alias("names"), F.col("new").alias("tracked"), F.col("dotted").alias("label"), "line",
            F.concat("pad", F.when(F.col("is_last"), "   ").otherwise("│  ")).alias("pad"), F.col("is_last").alias("last"),
        ))
        nodes = nodes.unionByName(level)
    return nodes


def hits(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks (fid, line, sink_type, sink_expr, severity, influenced, note) at the nodes: those without influenced names, or with a tracked one."""
    near = nodes.where("fid IS NOT NULL").select("repo", "root", "key", "fid", "tracked", "pad")
    return near.join(sinks, "fid").where((F.size("influenced") == 0) | F.arrays_overlap("influenced", "tracked"))


def sink_counts(functions: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, root, func, n): sinks per entry point; one that two call sites reach counts twice."""
    n = found.groupBy("root").agg(F.count("*").alias("n"))
    tools = functions.where("is_tool OR is_call_tool").select("repo", F.col("fid").alias("root"), "func")
    return tools.join(n, "root", "left").select("repo", "root", "func", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sinks_by_function(functions: DataFrame, sinks: DataFrame) -> DataFrame:
    return sinks.join(functions.select(*FUNCTION, "fid"), FUNCTION).drop(*FUNCTION)


def http_findings(functions: DataFrame, edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks of HTTP handlers, and of what they call, one level down: repo, fid, func, file, func_line, call_no (-1 for own sinks), sink_type, sink_expr, severity, line, note."""
    handlers = functions.where("is_http").select("repo", "fid", "func", "file", "func_line")
    own = handlers.join(sinks, "fid").select(*handlers.columns, F.lit(-1).alias("call_no"), "sink_type", "sink_expr", "severity", "line", "note")
    below = handlers.join(edges.where("target IS NOT NULL").withColumnRenamed("line", "at"), F.col("fid") == F.col("caller"))
    via = F.concat(F.lit("via "), "callee", F.lit("() at line "), F.col("at").cast("string"))
    reached = below.join(sinks.withColumnRenamed("fid", "target"), "target")
    return own.unionByName(reached.select(*handlers.columns, "call_no", "sink_type", F.concat("dotted", F.lit(" → "), "sink_expr").alias("sink_expr"), "severity", "line", via.alias("note")))


def _line(df: DataFrame, section: int, part: int | Column, text: Column, entry: Column | None = None, key: Column | None = None, **rest: Column) -> DataFrame:
    void = F.array().cast("array<long>")
    a, b, c = (rest.get(x, F.lit(0).cast("long") if x == "a" else F.lit("")) for x in "abc")
    order = [F.lit(section).alias("section"), (F.lit(0) if entry is None else entry).cast("long").alias("entry"), (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"), (void if key is None else key).alias("key"), a.cast("long").alias("a"), b.cast("string").alias("b"), c.cast("string").alias("c")]
    return df.select("repo", *order, text.alias("line"))


def tree_lines(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, ORDER, line) of the trees: a node with its place, what it reaches below it, then its calls."""
    place = F.when(F.col("fid").isNull(), "(external)").otherwise(F.concat(F.lit("["), "file", F.lit(":"), F.col("line").cast("string"), F.lit("]")))
    above = F.substring("pad", F.lit(1), F.length("pad") - 3)
    text = F.when(F.col("depth") == 0, F.concat(F.lit("  "), "label")).otherwise(F.concat(F.lit("  "), above, F.when(F.col("last"), "└─ ").otherwise("├─ "), "label", F.lit("  "), place))
    via = F.when(F.size("influenced") > 0, F.concat(F.lit("  (via: "), F.array_join("influenced", ", "), F.lit(")"))).otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit(" — "), "note")).otherwise("")
    mark = F.concat(F.lit("  "), "pad", F.lit("⚡ ["), "severity", F.lit("] "), "sink_type", F.lit(": "), "sink_expr", via, note)
    root = F.col("root")
    tree = _line(nodes, 1, 3, text, root, F.col("key"))
    return tree.unionByName(_line(found, 1, 3, mark, root, F.concat("key", F.array(F.lit(-1).cast("long"))), a=F.col("line"), b=F.col("sink_type"), c=F.col("sink_expr")))


def report_lines(functions: DataFrame, edges: DataFrame, sinks: DataFrame, files: DataFrame, depth: int = 4) -> DataFrame:
    """The whole flow report of each repository of files (repo, file): (repo, place, line).  functions are numbered ones, sinks have their function's fid."""
    nodes = shared.cut(trace(functions, edges, depth))
    found = shared.cut(hits(nodes, sinks))
    http = shared.cut(http_findings(functions, edges, sinks))
    tools = functions.where("is_tool OR is_call_tool")
    per = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    repos = files.groupBy("repo").agg(F.count_distinct("file").alias("n_files"))
    for df, name in ((functions, "n_functions"), (tools, "n_tools"), (found, "n_found"), (http, "n_http")):
        repos = repos.join(per(df, name), "repo", "left")
    repos = shared.cut(repos.fillna(0))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    col, entry = F.col, F.col("fid")
    total = col("n_found") + col("n_http")
    out = _line(repos, 0, 0, text("Flow report — ", col("repo")))
    out = out.unionByName(_line(repos, 0, 1, text("Indexed ", col("n_functions"), " function(s) in ", col("n_files"), " file(s); ", col("n_tools"), " entry point(s).")))
    out = out.unionByName(_line(tools, 1, 0, text("━━━ TOOL: ", col("func"), "  [", col("file"), ":", col("func_line"), "] ━━━"), entry))
    starts = nodes.where("depth = 0").select("repo", F.col("root").alias("fid"), "tracked")
    out = out.unionByName(_line(starts, 1, 1, F.when(F.size("tracked") > 0, "Parameters (all user-controlled):").otherwise("Parameters: (none)"), entry))
    out = out.unionByName(_line(starts.select("repo", "fid", F.explode("tracked").alias("p")), 1, 1, text("  • ", col("p")), entry, a=F.lit(1), b=col("p")))
    out = out.unionByName(_line(tools, 1, 2, text(f"Call tree (depth {depth}):"), entry)).unionByName(tree_lines(nodes, found))
    counts = shared.cut(sink_counts(functions, found).join(nodes.where("depth = 1").select("root").distinct().withColumn("calls", F.lit(True)), "root", "left").withColumnRenamed("root", "fid"))
    out = out.unionByName(_line(counts.where("n = 0 AND calls IS NULL"), 1, 4, text("  └─ (no outgoing calls found or no input flows out)"), entry))
    clean = f"Result: CLEAN — no dangerous sinks reached within depth {depth}"
    out = out.unionByName(_line(counts, 1, 5, F.when(col("n") == 0, clean).otherwise(text("Result: ", col("n"), " sink(s) reached")), entry))
    out = out.unionByName(_line(repos.where("n_http > 0"), 2, 0, text("━━━ HTTP HANDLERS ━━━")))
    note = F.when(col("note") != "", text(" — ", col("note"))).otherwise("")
    line = text("  [", col("severity"), "] ", col("func"), " [", col("file"), ":", col("func_line"), "]  ", col("sink_type"), ": ", col("sink_expr"), " [line ", col("line"), "]", note)
    out = out.unionByName(_line(http, 2, 1, line, entry, F.array(col("call_no").cast("long"), col("line").cast("long")), b=col("sink_type"), c=col("sink_expr")))
    closing = F.when(total == 0, "No dangerous sinks reachable from tool handlers or HTTP request parsers.").otherwise(text(total, " total finding(s)."))
    out = out.unionByName(_line(repos, 3, 0, closing))
    return shared.ranked_within(out, "repo", [F.col(c) for c in ORDER], "place").select("repo", "place", "line")
