"""Call-graph trace: depth-bounded, one unrolled join per level, data-parallel over entry points.

functions (name, params array<string>, is_tool, is_call_tool, is_http), calls (func, line, callee, pos array<array<string>>, kw map<string, array<string>>,
star boolean), sinks (func, line, sink_type, influenced array<string>).  A node of the trace is one path from an entry point; a diamond is two paths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared


def entries(functions: DataFrame) -> DataFrame:
    """Entry points as nodes of depth 0.  A call-tool entry with a parameter ``arguments`` tracks that one alone."""
    only = F.col("is_call_tool") & F.array_contains("params", "arguments")
    tracked = F.when(only, F.array(F.lit("arguments"))).otherwise(F.col("params"))
    return functions.where("is_tool OR is_call_tool").select(F.col("name").alias("root"), F.array("name").alias("path"), F.lit(0).alias("depth"), F.col("name").alias("func"), tracked.alias("tracked"))


def carried(tracked: Column) -> Column:
    """Some argument of the call holds a tracked name, or a tracked dictionary is spread."""
    return F.arrays_overlap(F.concat(F.flatten("pos"), F.flatten(F.map_values("kw"))), tracked) | F.col("star")


def mapped(tracked: Column, params: Column) -> Column:
    """The callee's parameters that tracked names reach: by position, up to its arity, and by keyword; all of them through a spread."""
    by_place = F.filter(F.transform("pos", lambda v, i: F.when(F.arrays_overlap(v, tracked), F.get(params, i))), lambda p: p.isNotNull())
    by_name = F.filter(params, lambda p: F.coalesce(F.arrays_overlap(F.try_element_at("kw", p), tracked), F.lit(False)))
    return F.when(F.col("star"), params).otherwise(F.array_distinct(F.concat(by_place, by_name)))


def trace(functions: DataFrame, calls: DataFrame, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, external leaves): nodes (root, path, depth, func, tracked); leaves (root, path, depth, callee, line).

    A callee on the path already is not entered again; one that no tracked name reaches is only entered with the caller's names if the call carries some.
    """
    callee = functions.select(F.col("name").alias("callee"), F.col("params").alias("callee_params"))
    joined = shared.salted_join(calls, callee, ["callee"])  # a name like "get" may hold a large part of all calls
    level, nodes, leaves = entries(functions), [], []
    nodes.append(level)
    for k in range(1, depth + 1):
        step = level.join(joined, "func").withColumn("carries", carried(F.col("tracked")))
        leaves.append(step.where("callee_params IS NULL AND carries").select("root", "path", F.lit(k).alias("depth"), "callee", "line"))
        inner = step.where(F.col("callee_params").isNotNull() & ~F.array_contains("path", F.col("callee"))).withColumn("new", mapped(F.col("tracked"), F.col("callee_params")))
        inner = inner.withColumn("new", F.when(F.size("new") > 0, F.col("new")).when(F.col("carries"), F.col("tracked"))).where("new IS NOT NULL")
        level = inner.select("root", F.array_append("path", F.col("callee")).alias("path"), F.lit(k).alias("depth"), F.col("callee").alias("func"), F.col("new").alias("tracked"))
        nodes.append(level)
    out, ext = nodes[0], leaves[0] if leaves else None
    for n in nodes[1:]:
        out = out.unionByName(n)
    for x in leaves[1:]:
        ext = ext.unionByName(x)
    return out, ext


def reached_sinks(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks at the nodes: those without influenced names, or with a tracked one."""
    hit = (F.size("influenced") == 0) | F.arrays_overlap("influenced", "tracked")
    return nodes.join(sinks, "func").where(hit).select("root", "path", "depth", "func", "line", "sink_type")


def sink_counts(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks per entry point; one that two paths reach counts twice."""
    found = reached_sinks(nodes, sinks).groupBy("root").agg(F.count("*").alias("n"))
    return nodes.where("depth = 0").select("root").join(found, "root", "left").select("root", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def http_findings(functions: DataFrame, calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks of HTTP handlers and of what they call, tracked or not."""
    handlers = functions.where("is_http").select(F.col("name").alias("handler"))
    own = handlers.join(sinks, F.col("handler") == F.col("func")).select("handler", F.col("func").alias("via"), "line", "sink_type")
    below = handlers.join(calls.select("func", "callee"), F.col("handler") == F.col("func")).drop("func").join(sinks, F.col("callee") == F.col("func")).select("handler", F.col("callee").alias("via"), "line", "sink_type")
    return own.unionByName(below)


def match_sinks(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """calls (id, dotted) with the sink types they match: last name equal, prefix equal or empty; one row per type and call."""
    last = F.substring_index("dotted", ".", -1)
    both = calls.withColumn("last", last).join(F.broadcast(catalogue), F.col("last") == F.col("function"))  # the catalogue is a fixed table
    fits = (F.col("module") == "") | (F.col("dotted") == F.concat("module", F.lit("."), "function")) | F.startswith("dotted", F.concat("module", F.lit(".")))
    return both.where(fits).select("id", "dotted", "sink_type", "severity").distinct()


def taint_closure(assignments: DataFrame, start: DataFrame) -> DataFrame:
    """(func, name) that derive from start (func, name) over assignments (func, target, source), however long the chain.

    One shuffle by function, whose names are followed in its task: a function is part of one file, which one task has parsed whole.
    """

    def follow(steps: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        reaches: dict[str, list[str]] = {}
        for source, target in zip(steps["source"], steps["target"], strict=True):
            reaches.setdefault(source, []).append(target)
        found = dict.fromkeys(known["name"])
        todo = list(found)
        while todo:
            fresh = [t for t in dict.fromkeys(reaches.get(todo.pop(), [])) if t not in found]
            found.update(dict.fromkeys(fresh))
            todo += fresh
        return pd.DataFrame({"func": known["func"].tolist()[:1] * len(found), "name": list(found)}, dtype=object)

    steps = assignments.select("func", "target", "source").where("target IS NOT NULL AND source IS NOT NULL").distinct()
    return steps.groupBy("func").cogroup(start.select("func", "name").distinct().groupBy("func")).applyInPandas(follow, "func string, name string")
