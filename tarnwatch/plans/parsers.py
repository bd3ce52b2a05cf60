"""Registered queries of the parsers and reviews.  Parsers can't be written in SQL: theirs lists the rows that were worked out by hand for every program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import flow as FL
from ..operators import review as R
from ..operators import structure as S
from ..operators.patterns import check_patterns
from ..functions import catalog
from ..sources.corpus import code_files, scannable
from . import duck
from . import programs as E
from .graphs import sink_catalogue
from .programs import programs


def _functions(s: SparkSession, d: str) -> DataFrame:
    return S.functions_of(programs(s, d))


def _sinks(s: SparkSession, d: str) -> DataFrame:
    return S.sinks_of(S.calls_of(S.functions_of(programs(s, d), S.SINK_RECORD)), sink_catalogue(s), sink_catalogue(s, catalog.SINKS_JS)).withColumn("influenced", F.array_join("influenced", ","))


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered functions, call sites and sinks of the programs, from one parse."""
    found = shared.cut(_functions(s, d))
    calls = S.calls_of(found)
    functions = FL.numbered(found.select("repo", "file", F.col("name").alias("func"), F.col("line_start").alias("func_line"), F.transform("params", lambda p: p["name"]).alias("params"), "is_tool", "is_call_tool", "is_http"))
    sinks = S.sinks_of(calls, sink_catalogue(s), sink_catalogue(s, catalog.SINKS_JS))
    return functions, FL.call_sites(functions, calls), shared.cut(FL.sinks_by_function(functions, sinks))


def _flow(s: SparkSession, d: str) -> DataFrame:
    """From source text to traced sinks: parse, match sinks, trace each repository's tools."""
    functions, edges, sinks = _graph(s, d)
    found = FL.hits(FL.trace(functions, edges), sinks)
    return FL.sink_counts(functions, found).select(F.concat("repo", F.lit("/"), "func").alias("root"), "n")


def _reports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    code = scannable(code_files(s, d))
    found = check_patterns(code, catalog.CREDENTIALS, "HARDCODED_CREDENTIAL")
    return R.report_text(found, "Credentials"), code


def _mentions(s: SparkSession, d: str) -> DataFrame:
    reports, code = _reports(s, d)
    return R.mentions(reports, code).select("repo", "file")


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Reviews of documents: JSON, fenced JSON and plain text."""
    doc = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    js = F.to_json(F.struct(F.concat(F.lit("about "), F.col("id").cast("string")).alias("summary"), F.array_repeat(F.struct(F.col("id").alias("id"), F.lit("HIGH").alias("severity")), (F.col("id") % 3).cast("int")).alias("findings")))
    return doc.select("id", F.when(F.col("id") % 4 == 0, F.col("text")).when(F.col("id") % 4 == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js).alias("reply"))


def _review(s: SparkSession, d: str) -> DataFrame:
    return R.parse_review(_replies(s, d)).select("id", "summary", F.size("findings").cast("long").alias("n"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    full = F.concat(F.lit('{"canary": "c", "validated_findings": [{"id": 1, "verdict": "false_positive"}, {"id": 2, "verdict": "'), F.when(F.col("id") % 2 == 0, "false_positive").otherwise("confirmed"), F.lit('"}], "new_findings": []}'))
    reply = F.when(F.col("id") % 5 == 0, F.left(full, F.lit(70))).when(F.col("id") % 7 == 0, F.lit("no json")).otherwise(full)
    checked = R.check_replies(docs.select("id", reply.alias("reply"), F.when(F.col("id") % 3 == 0, "x").otherwise("c").alias("canary"), F.lit(2).alias("expected")))
    return checked.select("id", F.array_join("problems", "; ").alias("problems"))


QUERIES = {
    "index_py": (lambda s, d: _functions(s, d).where(F.col("file").endswith(".py")).select("repo", "file", "name", "line_start", "line_end", F.size("params").alias("n_params"), F.size("calls").alias("n_calls"), "is_tool", "is_http"), E.INDEX_PY),
    "index_js": (lambda s, d: _functions(s, d).where(~F.col("file").endswith(".py")).select("repo", "file", "name", "line_start", "line_end", F.size("params").alias("n_params"), F.size("calls").alias("n_calls"), "is_tool"), E.INDEX_JS),
    "parsed_sinks": (_sinks, E.PARSED_SINKS),
    "flow_counts": (_flow, E.FLOW_COUNTS),
    "v1_call_graph": (lambda s, d: S.call_graph(programs(s, d)), E.CALL_GRAPH),
    "v1_risky_calls": (lambda s, d: S.risky_calls(programs(s, d)), E.RISKY_CALLS),
    "v2_taint": (lambda s, d: S.taint_v2(programs(s, d)), E.TAINT_V2),
    "auth_params": (lambda s, d: S.unvalidated_auth(programs(s, d)), E.AUTH_PARAMS),
    "sse_no_auth": (lambda s, d: S.stream_without_auth(programs(s, d)), E.SSE_NO_AUTH),
    "messages_unbound": (lambda s, d: S.messages_without_binding(programs(s, d)), E.MESSAGES),
    "reply_checks": (_checked, E.REPLY_CHECKS),
    "report_mentions": (_mentions, f"SELECT DISTINCT repo, file FROM ({duck.checked(catalog.CREDENTIALS, 'HARDCODED_CREDENTIAL')})"),
    "parse_ai_json": (_review, "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN left(text, 500) ELSE 'about ' || doc_id END AS summary, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 3 END AS n FROM documents"),
    "read_lines": (lambda s, d: R.read_lines(scannable(code_files(s, d)), 2, 4).select("repo", "file", "line", "shown"), f"WITH {duck.CODE} SELECT repo, file, line, printf('%5d | %s', line, text) AS shown FROM ({duck.LINES.format('code')}) WHERE line BETWEEN 2 AND 4"),
}
