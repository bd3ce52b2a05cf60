"""Parsers over a corpus: files -> functions, calls, sinks and findings as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import catalog
from ..functions.text import any_marker, extension
from . import extract_js, extract_py
from .store import Versioned

CALL = "callee string, dotted string, line int, pos array<array<string>>, kw map<string,array<string>>, star boolean, influenced array<string>, shell boolean, dynamic boolean"
#: What a sink is decided by.
SINK_RECORD = "name string, line_start int, calls array<struct<callee:string,dotted:string,line:int,influenced:array<string>,shell:boolean,dynamic:boolean>>"
RECORD = f"name string, line_start int, line_end int, params array<struct<name:string,annotation:string>>, decorators array<string>, is_tool boolean, is_call_tool boolean, is_http boolean, calls array<struct<{', '.join(c.replace(' ', ':', 1) for c in CALL.split(', '))}>>"


def parse(files: DataFrame, work: Callable[[str, str], list[dict]], schema: str, keep: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """The columns of keep and those fields of what work(file, content) finds that schema names, as typed Arrow rows."""
    spark = files.sparkSession
    found = T.StructType.fromJson(spark.createDataFrame([], schema).schema.jsonValue())
    arrow = to_arrow_type(T.ArrayType(found))
    out = T.StructType([*(files.schema[c] for c in keep), T.StructField("x", T.ArrayType(found))])

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {k: list(v.items()) if k == "kw" else plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(f or "", c or "") for f, c in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), strict=True)]
            rows = plain(rows) if "map<" in schema else rows
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(rows, arrow)], [*keep, "x"])

    listed = files.select(*dict.fromkeys([*keep, "file", "content"])).mapInArrow(run, out)
    return listed if keep != ("repo", "file") else listed.select("repo", "file", F.inline("x"))


def records(file: str, text: str) -> list[dict]:
    """Function records of a Python or a JavaScript file, by its own parser."""
    return extract_py.index_python(text) if file.lower().endswith(".py") else extract_js.index_js(text)


def functions_of(files: DataFrame, schema: str = RECORD) -> DataFrame:
    """Function records of Python and JavaScript files, whole or those fields that schema names."""
    return parse(files.where(extension(F.col("file")).isin(catalog.SOURCE_EXTENSIONS)), records, schema)


class FunctionIndex:
    """Function records of a corpus, parsed once: a stored table with one row per file, (repo, file, hash, functions).

    ``update`` parses the files whose content is not in it yet and leaves those out that are gone; files that hold no function are rows, too, and aren't parsed again.
    """

    SCHEMA = f"repo string, file string, hash string, x array<struct<{RECORD}>>"

    def __init__(self, spark: SparkSession, path: str, work: Callable[[str, str], list[dict]] = records) -> None:
        self.table, self.work = Versioned(spark, path, self.SCHEMA), work

    def update(self, files: DataFrame) -> DataFrame:
        """The function records of files, as ``functions_of`` gives them."""
        key = ["repo", "file", "hash"]
        known = files.where(extension(F.col("file")).isin(catalog.SOURCE_EXTENSIONS)).select("repo", "file", F.sha2("content", 256).alias("hash"), "content")

        def change(old: DataFrame) -> DataFrame:
            kept = old.join(known.select(*key).distinct(), key, "left_semi")
            fresh = parse(known.join(old.select(*key), key, "left_anti"), self.work, RECORD, ("repo", "file", "hash"))
            return kept.unionByName(fresh)

        return self.table.update(change).select("repo", "file", F.inline("x"))


def calls_of(functions: DataFrame) -> DataFrame:
    """One row per call: repo, file, func, func_line, call_no (in the order of the record), and what the record says."""
    listed = functions.select("repo", "file", F.col("name").alias("func"), F.col("line_start").alias("func_line"), F.posexplode("calls").alias("call_no", "call"))
    return listed.select("repo", "file", "func", "func_line", "call_no", "call.*")


def sinks_of(calls: DataFrame, python_sinks: DataFrame, js_sinks: DataFrame) -> DataFrame:
    """Calls that match a sink catalogue, one row per sink type and call.

    Python sinks count untainted too (reachability is decided along the trace); JavaScript ones need a tainted argument, or a built one for COMMAND and EXEC.
    """
    both = python_sinks.withColumn("js", F.lit(False)).unionByName(js_sinks.withColumn("js", F.lit(True)))
    listed = both.groupBy(F.col("function").alias("callee"), "js").agg(F.collect_list(F.struct("module", "sink_type", "severity")).alias("listed"))
    js, dynamic = F.col("js"), F.col("dynamic")
    c = calls.withColumn("js", F.col("file").rlike(r"(?i)\.(js|ts|jsx|tsx|mjs|mts)$")).join(F.broadcast(listed), ["callee", "js"], "left")  # fixed tables
    tainted = F.size("influenced") > 0

    def reached(k: Column) -> Column:
        fits = (k["module"] == "") | (F.col("dotted") == F.concat(k["module"], F.lit("."), "callee")) | F.startswith("dotted", F.concat(k["module"], F.lit(".")))
        return fits & (~js | tainted | (k["sink_type"].isin("COMMAND", "EXEC") & dynamic))

    def sink(k: Column) -> Column:
        command = k["sink_type"] == "COMMAND"
        note = F.when(command & F.col("shell"), "shell=True — CRITICAL").when(command & js & dynamic, "template literal injection — CRITICAL").when(F.col("callee") == "new Function", "dynamic code construction").otherwise("")
        return F.struct(k["sink_type"].alias("sink_type"), k["severity"].alias("severity"), note.alias("note"), F.lit(False).alias("sql"))

    methods = F.when(js, F.array(*map(F.lit, catalog.SQL_METHODS_JS))).otherwise(F.array(*map(F.lit, catalog.SQL_METHODS_PY)))
    is_sql = F.array_contains(methods, F.col("callee")) & (tainted | (~js & dynamic))
    sql = F.struct(F.lit("SQL").alias("sink_type"), F.lit("HIGH").alias("severity"), F.when(dynamic, "dynamic SQL construction").otherwise("").alias("note"), F.lit(True).alias("sql"))
    found = F.concat(F.transform(F.filter(F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)), reached), sink), F.when(is_sql, F.array(sql)).otherwise(F.array().cast("array<struct<sink_type:string,severity:string,note:string,sql:boolean>>")))
    # both kinds in one pass, so that what the calls come from is parsed once; SQL sinks are one row per call as they are
    rows = c.withColumn("_call", F.monotonically_increasing_id()).select("repo", "file", "func", "func_line", F.col("dotted").alias("sink_expr"), "line", "influenced", "_call", F.inline(found)).withColumn("_call", F.when(F.col("sql"), F.col("_call")))
    return rows.dropDuplicates(["repo", "file", "func", "func_line", "sink_type", "sink_expr", "line", "_call"]).select("repo", "file", "func", "func_line", "sink_type", "sink_expr", "severity", "line", "influenced", "note")


def call_graph(files: DataFrame) -> DataFrame:
    """Distinct (src, dst) edges of all files."""
    py = files.where(F.col("file").endswith(".py"))
    return parse(py, lambda _, text: [{"src": a, "dst": b} for a, b in extract_py.call_graph_v1(text)[0]], "src string, dst string").select("repo", "src", "dst").distinct()


def risky_calls(files: DataFrame) -> DataFrame:
    return parse(files.where(F.col("file").endswith(".py")), lambda _, text: [{"call": a, "line": b} for a, b in extract_py.call_graph_v1(text)[1]], "call string, line int")


FINDING = "type string, func string, line int, sink string, severity string"


def taint_v2(files: DataFrame) -> DataFrame:
    return parse(files.where(F.col("file").endswith(".py")), lambda _, text: extract_py.taint_v2(text), FINDING)


def unvalidated_auth(files: DataFrame) -> DataFrame:
    return parse(files.where(F.col("file").endswith(".py")), lambda _, text: extract_py.unvalidated_auth(text), FINDING)


def handlers(files: DataFrame, pattern_py: str, pattern_js: str) -> DataFrame:
    """(repo, file, line, src, match): the function around each match in Python, 15 lines before and after it elsewhere; one row per start."""
    import re

    def work(file: str, text: str) -> list[dict]:
        python = file.endswith(".py")
        found = [(text.count("\n", 0, m.start()) + 1, m[1] if m.re.groups else m[0]) for m in re.finditer(pattern_py if python else pattern_js, text)]
        lines, out = text.split("\n"), {}
        for n, match in found:
            around = extract_py.enclosing_functions(text, [n]) if python else [(max(1, n - 15), "\n".join(lines[max(0, n - 16) : n + 15]))]
            for start, src in around:
                out.setdefault(start, {"line": start, "src": src, "match": match})
        return list(out.values())

    return parse(files, work, "line int, src string, match string")


def stream_without_auth(files: DataFrame) -> DataFrame:
    """Event-stream handlers without a sign of authentication."""
    gate = files.where(F.col("content").rlike(catalog.STREAM_HANDLER))
    found = handlers(gate, catalog.STREAM_HANDLER, catalog.STREAM_HANDLER)
    return found.where(~any_marker(F.col("src"), catalog.HANDLER_AUTH_MARKERS)).select("repo", "file", "line", F.lit("SSE_NO_AUTH").alias("type"), F.lit("HIGH").alias("severity"))


def messages_without_binding(files: DataFrame) -> DataFrame:
    """Message routes that read a session id and bind it to nothing."""
    found = handlers(files.where(F.contains("content", F.lit("/message"))), catalog.MESSAGES_ROUTE_PY, catalog.MESSAGES_ROUTE_JS)
    open_ones = found.where(F.col("src").rlike("(?d)" + catalog.SESSION_ID_READ) & ~any_marker(F.col("src"), catalog.SESSION_BIND_MARKERS))
    return open_ones.select("repo", "file", "line", F.lit("MCP_MESSAGES_NO_SESSION_BIND").alias("type"), F.lit("MEDIUM").alias("severity"), F.concat(F.lit("POST "), "match").alias("match"))
