"""Registered queries of the report outputs and the relations around costs and reads: name -> (query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import catalog
from ..operators import flow as FL
from ..operators import patterns as P
from ..operators import reports as O
from ..operators import trace as T
from ..sources.corpus import code_files, pick, scannable
from . import duck, graphs
from .duck import q

RANK = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(catalog.SEVERITIES)) + " ELSE 9 END"
PLACE = "CASE WHEN coalesce(file, '') = '' THEN '(repo-wide)' WHEN coalesce(line, 0) = 0 THEN file ELSE file || ':' || line END"
SEVERITIES = [*catalog.SEVERITIES, "ODD"]


def _code(s: SparkSession, d: str) -> DataFrame:
    return scannable(code_files(s, d))


def _stream(s: SparkSession, d: str) -> DataFrame:
    code = _code(s, d)
    return O.stream_findings(P.stream_ssrf(code), P.redirects(code), P.cors_misconfig(code), P.origin_missing(code))


def _stream_blocks(s: SparkSession, d: str) -> DataFrame:
    return O.blocks(_stream(s, d), [("Match", "match"), ("Note", "note")], O.worst_first("type"))


def _auth_blocks(s: SparkSession, d: str) -> DataFrame:
    code, out = _code(s, d), None
    for patterns, kind in ((catalog.CREDENTIALS, "HARDCODED_CREDENTIAL"), (catalog.JWT_MISUSE, "JWT_MISUSE"), (catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS"), (catalog.INSECURE_SESSION, "INSECURE_SESSION")):
        found = P.check_patterns(code, patterns, kind)
        out = found if out is None else out.unionByName(found)
    return O.blocks(out, [("Match", "match"), ("Detail", "detail")], [F.col("file"), F.col("line"), F.col("type")])


def _network_blocks(s: SparkSession, d: str) -> DataFrame:
    found = P.network_bindings(_code(s, d), snippet=True).withColumn("type", F.lit("NETWORK_BINDING"))
    address = F.when(F.col("host") != "(unresolved)", F.concat("host", F.when(F.coalesce("port", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise("")))
    return O.blocks(found.withColumn("address", address), [("Address", "address"), ("Code", "code"), ("Detail", "note")], [F.col("file"), F.col("line")])


def _heads(s: SparkSession, d: str) -> DataFrame:
    return O.heads(_stream(s, d), _code(s, d), " SSE/streaming issue(s) found:", "No SSE/streaming security issues found.")


def findings(s: SparkSession, d: str) -> DataFrame:
    """One finding per document; some without file, line or title."""
    i = F.col("doc_id")
    doc = s.read.parquet(f"{d}/documents.parquet")
    return doc.select(
        F.col("source").alias("repo"), i.alias("id"), pick(SEVERITIES, i).alias("severity"), F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("Finding <"), i.cast("string"), F.lit(">"))).alias("title"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("src/f"), (i % 50).cast("string"), F.lit(".py"))).alias("file"), F.when(i % 7 == 0, None).otherwise(i % 400).alias("line"),
        F.concat(F.lit("what & why "), (i % 17).cast("string")).alias("description"), F.when(i % 5 == 0, None).otherwise(F.lit("fix it")).alias("recommendation"),
    )


FINDINGS = f"""f AS (SELECT source AS repo, doc_id AS id, {duck.pick(SEVERITIES, 'doc_id')} AS severity, CASE WHEN doc_id % 11 <> 0 THEN 'Finding <' || doc_id || '>' END AS title,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'src/f' || (doc_id % 50) || '.py' END AS file, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 400 END AS line, 'what & why ' || (doc_id % 17) AS description, CASE WHEN doc_id % 5 <> 0 THEN 'fix it' END AS recommendation FROM documents)"""
LANGUAGES = ["python", "js", "unknown"]


def states(s: SparkSession, d: str) -> DataFrame:
    """One run per customer: counts that may be -1 or unset, scanner reports, a review, sometimes an error."""
    k = F.col("c_custkey")
    count = lambda m, n: F.when(k % m == 0, -1).when(k % m == 1, None).otherwise(k % n)
    return s.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.when(k % 40 == 0, "a-repository-with-quite-a-long-name-").otherwise("r"), k.cast("string")).alias("repo"), pick(LANGUAGES, k).alias("language"), count(5, 9).alias("flow"), count(7, 12).alias("network"),
        count(6, 10).alias("stream"), count(8, 4).alias("auth"), F.when(k % 3 == 0, -1).otherwise(k % 4).alias("bandit"), F.when(k % 4 == 0, None).otherwise(k % 3).alias("semgrep"),
        F.when(k % 2 == 0, F.concat(F.lit("out/b"), k.cast("string"))).alias("bandit_path"), F.when(k % 9 == 0, F.concat(F.lit("out/s"), k.cast("string"))).otherwise("").alias("semgrep_path"),
        F.when(k % 5 == 0, "AI disabled by user").when(k % 5 == 1, "").otherwise("a review").alias("review"), F.when(k % 23 == 0, F.concat(F.lit("clone failed: "), F.repeat(F.lit("x"), 70))).alias("error"),
        (k % 10 == 0).alias("offline"), F.when(k % 4 == 0, None).otherwise(k % 3 != 0).alias("ai"),
    )


def _count(m: int, n: int) -> str:
    return f"CASE WHEN c_custkey % {m} = 0 THEN -1 WHEN c_custkey % {m} = 1 THEN NULL ELSE c_custkey % {n} END"


STATES = f"""st AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN 'a-repository-with-quite-a-long-name-' ELSE 'r' END || c_custkey AS repo, {duck.pick(LANGUAGES, 'c_custkey')} AS language, {_count(5, 9)} AS flow, {_count(7, 12)} AS network, {_count(6, 10)} AS stream, {_count(8, 4)} AS auth,
  CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey % 4 END AS bandit, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END AS semgrep, CASE WHEN c_custkey % 2 = 0 THEN 'out/b' || c_custkey END AS bandit_path, CASE WHEN c_custkey % 9 = 0 THEN 'out/s' || c_custkey ELSE '' END AS semgrep_path,
  CASE c_custkey % 5 WHEN 0 THEN 'AI disabled by user' WHEN 1 THEN '' ELSE 'a review' END AS review, CASE WHEN c_custkey % 23 = 0 THEN 'clone failed: ' || repeat('x', 70) END AS error,
  c_custkey % 10 = 0 AS offline, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 <> 0 END AS ai FROM customer)"""


def _shown(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = -1 THEN '—' ELSE {c}::VARCHAR END"


_static = "CASE WHEN greatest(coalesce(bandit, 0), 0) + greatest(coalesce(semgrep, 0), 0) > 0 THEN greatest(coalesce(bandit, 0), 0) + greatest(coalesce(semgrep, 0), 0) WHEN coalesce(bandit_path, '') = '' AND coalesce(semgrep_path, '') = '' THEN -1 ELSE 0 END"
_ai = "CASE WHEN coalesce(review, '') <> '' AND NOT contains(lower(coalesce(review, '')), 'disabled') THEN '✓' ELSE '—' END"
SUMMARY = f"""WITH {STATES}, r AS (SELECT repo, language, {_shown('flow')} AS flow, {_shown('network')} AS network, {_shown('auth')} AS auth, {_shown('(' + _static + ')')} AS static, {_ai} AS ai, error, (SELECT greatest(max(length(repo)), 28) FROM st)::INT AS w FROM st)
SELECT repo, CASE WHEN error IS NOT NULL THEN rpad(repo, w, ' ') || '  ERROR: ' || left(error, 60) ELSE rpad(repo, w, ' ') || '  ' || rpad(language, 8, ' ') || '  ' || lpad(flow, 8, ' ') || '  ' || lpad(network, 7, ' ') || '  ' || lpad(auth, 4, ' ') || '  ' || lpad(static, 6, ' ') || '  ' || lpad(ai, 3, ' ') END AS line FROM r"""


def _tiles(s: SparkSession, d: str) -> DataFrame:
    st = states(s, d).withColumn("static", F.greatest(F.coalesce("bandit", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("semgrep", F.lit(0)), F.lit(0)))
    return O.html_tiles(st.withColumn("findings", F.length("review")))


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


_static_tile = "greatest(coalesce(bandit, 0), 0) + greatest(coalesce(semgrep, 0), 0)"
_tile_sql = " || ".join(f"'<li><b>' || {v} || '</b> {c}</li>'" for c, v in [*((c, f"greatest(coalesce({c}, 0), 0)") for c in ("flow", "network", "stream", "auth")), ("static", f"({_static_tile})"), ("findings", "length(review)")])
_colors = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {q(c)}" for s, c in catalog.SEVERITY_COLORS.items()) + f" ELSE {q(catalog.SEVERITY_COLOR)} END"


def _sections(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/pages.parquet")
    k = F.col("page_id")
    title = pick(catalog.REPORT_SECTIONS, k)
    return O.html_sections(p.select(F.concat(F.lit("repo"), (k % 9).cast("string")).alias("repo"), k.alias("place"), title.alias("title"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("html")).alias("body"), F.when(k % 3 == 0, -1).otherwise(k % 5).alias("count")))


def _page(s: SparkSession, d: str) -> DataFrame:
    """A page per source: tiles from the severities of its findings, a section per document, all findings."""
    found = findings(s, d).withColumn("title", F.coalesce("title", F.lit("")))
    counts = [F.count_if(F.col("severity") == x).alias(c) for c, x in zip(O.TILES, catalog.SEVERITIES, strict=True)]
    st = found.groupBy("repo").agg(F.lit("python").alias("language"), *counts, F.count("*").alias("findings"))
    k = F.col("doc_id")
    sections = s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("repo"), k.alias("place"), pick(catalog.REPORT_SECTIONS, k).alias("title"), F.col("text").alias("body"), (k % 5 - 1).alias("count"))
    return O.html_page(st, sections, found)


def _projects(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    names = ["setup.py", "src/setup.py", "package.json", "requirements.txt", "web/package.json", "README.md", "pyproject.toml"]
    return O.project_types(c.select(F.concat(F.lit("p"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("repo"), pick(names, F.col("c_custkey") * 5 + F.floor(F.col("c_custkey") / 11)).alias("file")))


def _validation_chars(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    reviews = docs.groupBy(F.col("source").alias("repo")).agg(F.max("text").alias("review"))
    return O.validation_chars(reviews, docs.select(F.col("source").alias("repo"), F.left("text", F.lit(8000)).alias("text")))


def _gate(s: SparkSession, d: str) -> DataFrame:
    """Costs of all runs that did not fail against four thresholds; those of customers with an odd key are left unknown, and count 0."""
    st = O.healthy(states(s, d))
    costs = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo"), (F.col("c_custkey") / 1024.0).alias("cost"))
    each = O.with_costs(st.select("repo"), costs)
    out = None
    for threshold in (-1.0, 0.0, 5.0, 1e12):
        row = O.ask_first(each, threshold).select(F.lit(threshold).alias("threshold"), F.round("total", 6).alias("total"), "ask")
        out = row if out is None else out.unionByName(row)
    return out


RUNS = {"all": "true", "whole": "error IS NULL", "clean": "error IS NULL AND coalesce(flow, 0) <= 0 AND coalesce(auth, 0) <= 0 AND coalesce(bandit, 0) <= 0"}


def _exit_codes(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, which in RUNS.items():
        row = O.exit_code(states(s, d).where(which)).select(F.lit(name).alias("runs"), "code")
        out = row if out is None else out.unionByName(row)
    return out


def _log(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.concat(F.lit("src/f"), (F.col("event_id") % 23).cast("string")).alias("path"), F.col("event_type").alias("tool"))


def _flow_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of ``part`` as numbered functions, call sites and sinks; a quarter of the functions calls its first callee twice."""
    functions, calls, sinks = graphs.graph(s, d)
    k = F.substring("name", F.lit(2), F.length("name")).cast("long")
    placed = functions.select(F.lit("r").alias("repo"), F.concat(F.lit("src/f"), (k % 10).cast("string"), F.lit(".py")).alias("file"), F.col("name").alias("func"), k.alias("func_line"), "params", "is_tool", "is_call_tool", "is_http")
    numbered = FL.numbered(placed)
    again = calls.where("line = 1 AND CAST(substring(func, 2) AS BIGINT) % 4 = 1").withColumns({"line": F.lit(3), "pos": F.array(F.array(F.lit("b"))), "star": F.lit(False)})
    where = placed.select("repo", "file", "func", "func_line")
    sites = calls.unionByName(again).withColumns({"call_no": F.col("line") - 1, "dotted": F.col("callee")}).join(where, "func")
    found = sinks.select("func", "line", "sink_type", F.concat("func", F.lit("()")).alias("sink_expr"), F.when(F.col("sink_type") == "FILE", "MEDIUM").otherwise("HIGH").alias("severity"), "influenced", F.lit("").alias("note")).join(where, "func")
    return numbered, FL.call_sites(numbered, sites), shared.cut(FL.sinks_by_function(numbered, found))


def _tree(s: SparkSession, d: str) -> DataFrame:
    functions, edges, sinks = _flow_graph(s, d)
    nodes = shared.cut(FL.trace(functions, edges))
    lines = FL.tree_lines(nodes, FL.hits(nodes, sinks))
    return shared.ranked_within(lines, "entry", [F.col(c) for c in ("key", "a", "b", "c")], "place").select(F.col("entry").alias("root"), "place", "line")


def _flow_report(s: SparkSession, d: str) -> DataFrame:
    functions, edges, sinks = _flow_graph(s, d)
    return FL.report_lines(functions, edges, sinks, functions.select("repo", "file").distinct())


def _results(s: SparkSession, d: str) -> DataFrame:
    functions, calls, sinks = graphs.graph(s, d)
    nodes, _ = T.trace(functions, calls)
    return O.trace_results(nodes, T.sink_counts(nodes, sinks))


_flow_head = f"""{graphs._head},
fx AS (SELECT *, row_number() OVER (ORDER BY file, name, func_line) AS fid FROM (SELECT f.*, 'src/f' || (k % 10) || '.py' AS file, k AS func_line FROM functions f JOIN p ON f.name = 'f' || k)),
cx AS (SELECT *, line - 1 AS call_no FROM calls UNION ALL SELECT func, 3, callee, [['b']], false, 2 FROM calls WHERE line = 1 AND substr(func, 2)::BIGINT % 4 = 1),
ed AS (SELECT o.fid AS caller, call_no, line, callee, pos, star, t.fid AS target, t.file AS tfile, t.params AS cp FROM cx JOIN fx o ON o.name = func LEFT JOIN fx t ON t.name = callee),
sx AS (SELECT fid, line, sink_type, func || '()' AS sink, CASE WHEN sink_type = 'FILE' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, influenced FROM sinks JOIN fx ON name = func),
n AS (
  SELECT fid AS root, []::BIGINT[] AS key, 0 AS depth, fid, file, [name] AS names, CASE WHEN is_call_tool AND list_contains(params, 'arguments') THEN ['arguments'] ELSE params END AS tracked, name AS label, func_line::BIGINT AS line FROM fx WHERE is_tool OR is_call_tool
  UNION ALL
  SELECT root, list_concat(key, [call_no::BIGINT, coalesce(target, 0)]), depth + 1, target, tfile, list_append(names, callee), CASE WHEN target IS NULL THEN [] WHEN len(new) > 0 THEN new ELSE tracked END, callee, call_line::BIGINT FROM (
    SELECT n.root, n.key, n.depth, n.names, n.tracked, call_no, target, tfile, callee, ed.line AS call_line, list_has_any(flatten(pos), n.tracked) OR star AS carries,
      CASE WHEN star THEN cp ELSE list_filter([CASE WHEN list_has_any(pos[1], n.tracked) THEN cp[1] END, CASE WHEN list_has_any(pos[2], n.tracked) THEN cp[2] END], lambda x: x IS NOT NULL) END AS new
    FROM n JOIN ed ON ed.caller = n.fid WHERE n.depth < 4) x WHERE (target IS NULL AND carries) OR (target IS NOT NULL AND NOT list_contains(names, callee) AND (len(new) > 0 OR carries))
),
sib AS (SELECT root, key, lead(key) OVER (PARTITION BY root, key[:-3] ORDER BY key) IS NULL AS last FROM n WHERE depth > 0),
up AS (SELECT n.root, n.key, i, s.last FROM (SELECT root, key, unnest(range(1, depth + 1)) AS i FROM n) n JOIN sib s ON s.root = n.root AND s.key = n.key[:2 * n.i]),
pads AS (SELECT root, key, string_agg(CASE WHEN last THEN '   ' ELSE '│  ' END, '' ORDER BY i) AS pad, arg_max(last, i) AS last FROM up GROUP BY root, key),
nx AS (SELECT n.*, coalesce(pad, '') AS pad, last FROM n LEFT JOIN pads USING (root, key)),
hit AS (SELECT n.root, n.key, n.pad, s.* FROM nx n JOIN sx s ON s.fid = n.fid WHERE len(influenced) = 0 OR list_has_any(influenced, tracked)),
tree AS (SELECT root, key, 0 AS a, '' AS b, '' AS c, CASE WHEN depth = 0 THEN '  ' || label ELSE '  ' || pad[:-4] || CASE WHEN last THEN '└─ ' ELSE '├─ ' END || label || '  ' || CASE WHEN fid IS NULL THEN '(external)' ELSE '[' || file || ':' || line || ']' END END AS line FROM nx
  UNION ALL SELECT root, list_append(key, -1), line, sink_type, sink, '  ' || pad || '⚡ [' || severity || '] ' || sink_type || ': ' || sink || CASE WHEN len(influenced) > 0 THEN '  (via: ' || array_to_string(influenced, ', ') || ')' ELSE '' END FROM hit)"""
_tree_sql = f"{_flow_head} SELECT root, row_number() OVER (PARTITION BY root ORDER BY key, a, b, c) AS place, line FROM tree"
_flow_sql = f"""{_flow_head},
http AS (SELECT h.name, h.file, h.func_line, h.fid, -1 AS call_no, sink_type, sink, severity, s.line, '' AS note FROM fx h JOIN sx s ON s.fid = h.fid WHERE is_http
  UNION ALL SELECT h.name, h.file, h.func_line, h.fid, call_no, sink_type, callee || ' → ' || sink, severity, s.line, ' — via ' || callee || '() at line ' || e.line FROM fx h JOIN ed e ON e.caller = h.fid JOIN sx s ON s.fid = e.target WHERE is_http),
cnt AS (SELECT t.fid, name, file, func_line, count(h.root) AS n FROM fx t LEFT JOIN hit h ON h.root = t.fid WHERE is_tool OR is_call_tool GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM fx) AS f, (SELECT count(DISTINCT file) FROM fx) AS files, (SELECT count(*) FROM cnt) AS t, (SELECT count(*) FROM http) AS h, (SELECT count(*) FROM hit) + (SELECT count(*) FROM http) AS alls),
l AS (SELECT 0 AS s, 0 AS e, 0 AS p, []::BIGINT[] AS key, 0 AS a, '' AS b, '' AS c, 'Flow report — r' AS line
  UNION ALL SELECT 0, 0, 1, [], 0, '', '', 'Indexed ' || f || ' function(s) in ' || files || ' file(s); ' || t || ' entry point(s).' FROM tot
  UNION ALL SELECT 1, fid, 0, [], 0, '', '', '━━━ TOOL: ' || name || '  [' || file || ':' || func_line || '] ━━━' FROM cnt
  UNION ALL SELECT 1, root, 1, [], 0, '', '', CASE WHEN len(tracked) > 0 THEN 'Parameters (all user-controlled):' ELSE 'Parameters: (none)' END FROM n WHERE depth = 0
  UNION ALL SELECT 1, root, 1, [], 1, x, '', '  • ' || x FROM (SELECT root, unnest(tracked) AS x FROM n WHERE depth = 0)
  UNION ALL SELECT 1, fid, 2, [], 0, '', '', 'Call tree (depth 4):' FROM cnt
  UNION ALL SELECT 1, root, 3, key, a, b, c, line FROM tree
  UNION ALL SELECT 1, fid, 4, [], 0, '', '', '  └─ (no outgoing calls found or no input flows out)' FROM cnt WHERE n = 0 AND fid NOT IN (SELECT root FROM n WHERE depth = 1)
  UNION ALL SELECT 1, fid, 5, [], 0, '', '', CASE WHEN n = 0 THEN 'Result: CLEAN — no dangerous sinks reached within depth 4' ELSE 'Result: ' || n || ' sink(s) reached' END FROM cnt
  UNION ALL SELECT 2, 0, 0, [], 0, '', '', '━━━ HTTP HANDLERS ━━━' FROM tot WHERE h > 0
  UNION ALL SELECT 2, fid, 1, [call_no, line], 0, sink_type, sink, '  [' || severity || '] ' || name || ' [' || file || ':' || func_line || ']  ' || sink_type || ': ' || sink || ' [line ' || line || ']' || note FROM http
  UNION ALL SELECT 3, 0, 0, [], 0, '', '', CASE WHEN alls = 0 THEN 'No dangerous sinks reachable from tool handlers or HTTP request parsers.' ELSE alls || ' total finding(s).' END FROM tot)
SELECT 'r' AS repo, row_number() OVER (ORDER BY s, e, p, key, a, b, c) AS place, line FROM l"""

_notes = "CASE type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in catalog.STREAM_NOTES.items()) + " END"
STREAM_FOUND = f"""(SELECT * FROM (SELECT *, {_notes} AS note, row_number() OVER (PARTITION BY repo, type, file, line ORDER BY match) AS n FROM (
  SELECT repo, file, line, type, severity, match FROM ({duck.SSRF}) UNION ALL SELECT repo, file, line, type, severity, match FROM ({duck.REDIRECTS})
  UNION ALL SELECT repo, file, line, type, severity, match FROM ({duck.CORS}) UNION ALL SELECT repo, file, line, type, severity, match FROM ({duck.ORIGIN}))) WHERE n = 1)"""
_auth = " UNION ALL ".join(f"SELECT * FROM ({duck.checked(p, k)})" for p, k in ((catalog.CREDENTIALS, "HARDCODED_CREDENTIAL"), (catalog.JWT_MISUSE, "JWT_MISUSE"), (catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS"), (catalog.INSECURE_SESSION, "INSECURE_SESSION")))
NL = "chr(10)"


def _block_sql(found: str, fields: list[tuple[str, str]], order: str) -> str:
    width = max(len(a) for a, _ in fields)
    more = "".join(f" || CASE WHEN coalesce({c}::VARCHAR, '') <> '' THEN {NL} || {q('  ' + a.ljust(width) + ': ')} || {c} ELSE '' END" for a, c in fields)
    return f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {order}) AS place, '[' || severity || '] ' || type || {NL} || {q('  ' + 'File'.ljust(width) + ': ')} || {PLACE}{more} AS block FROM {found}"


_bind = f"""(SELECT repo, file, line, 'NETWORK_BINDING' AS type, severity, CASE WHEN host <> '(unresolved)' THEN host || CASE WHEN coalesce(port, 0) <> 0 THEN ':' || port ELSE '' END END AS address, note,
  trim(text[greatest(instr(text, m1), 1):greatest(instr(text, m1), 1) + len_m + 59]) AS code FROM (
  SELECT b.*, f.text, split_part(f.match, chr(10), 1) AS m1, length(f.match) AS len_m FROM bind b JOIN ({duck.first(duck.matches('code', [(p, '', '') for p, _, _ in catalog.BINDINGS]), 'repo, file, line')}) f ON f.repo = b.repo AND f.file = b.file AND f.line = b.line))"""

QUERIES = {
    "stream_blocks": (_stream_blocks, _block_sql(STREAM_FOUND, [("Match", "match"), ("Note", "note")], f"{RANK}, file, coalesce(line, 0), type")),
    "stream_heads": (_heads, f"SELECT r.repo, CASE WHEN n IS NULL THEN 'No SSE/streaming security issues found.' ELSE n || ' SSE/streaming issue(s) found:' END AS head FROM (SELECT DISTINCT repo FROM (WITH {duck.CODE} SELECT repo FROM code)) r LEFT JOIN (SELECT repo, count(*) AS n FROM {STREAM_FOUND} GROUP BY repo) f ON f.repo = r.repo"),
    "auth_blocks": (_auth_blocks, _block_sql(f"({_auth})", [("Match", "match"), ("Detail", "detail")], "file, line, type")),
    "network_blocks": (_network_blocks, f"WITH {duck.CODE}, {duck.BIND_CTE} " + _block_sql(_bind, [("Address", "address"), ("Code", "code"), ("Detail", "note")], "file, line")),
    "keyword_report": (lambda s, d: P.keyword_lines(code_files(s, d)).select("repo", F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" - "), "keyword", F.lit(" -> "), "text").alias("line")), f"SELECT repo, file || ':' || line || ' - ' || keyword || ' -> ' || text AS line FROM ({duck.KEYWORDS})"),
    "trace_tree": (_tree, _tree_sql),
    "flow_report": (_flow_report, _flow_sql),
    "trace_results": (_results, f"{graphs._head} SELECT root, CASE WHEN n = 0 THEN 'Result: CLEAN — no dangerous sinks reached within depth 4' ELSE 'Result: ' || n || ' sink(s) reached' END AS result FROM (SELECT e.root, count(s.func) AS n FROM (SELECT DISTINCT root FROM nodes) e LEFT JOIN nodes n ON n.root = e.root LEFT JOIN sinks s ON s.func = n.func AND (len(influenced) = 0 OR list_has_any(influenced, tracked)) GROUP BY e.root)"),
    "project_types": (_projects, f"SELECT repo, CASE WHEN bool_or(file IN ('setup.py', 'pyproject.toml', 'requirements.txt')) THEN 'python' WHEN bool_or(file = 'package.json') THEN 'node' ELSE 'unknown' END AS project FROM (SELECT 'p' || (c_custkey // 3) AS repo, {duck.pick(['setup.py', 'src/setup.py', 'package.json', 'requirements.txt', 'web/package.json', 'README.md', 'pyproject.toml'], 'c_custkey * 5 + c_custkey // 11')} AS file FROM customer) GROUP BY repo"),
    "summary_lines": (lambda s, d: O.summary_lines(states(s, d)), SUMMARY),
    "healthy_runs": (lambda s, d: O.healthy(states(s, d)).select("repo", "language"), f"WITH {STATES} SELECT repo, language FROM st WHERE error IS NULL"),
    "report_paths": (lambda s, d: O.report_paths(states(s, d), ["bandit_path", "semgrep_path"]), f"WITH {STATES} SELECT repo, 'bandit_path' AS kind, bandit_path AS path FROM st WHERE coalesce(bandit_path, '') <> '' UNION ALL SELECT repo, 'semgrep_path', semgrep_path FROM st WHERE coalesce(semgrep_path, '') <> ''"),
    "html_tiles": (_tiles, f"WITH {STATES} SELECT repo, '<h1>' || {_esc('repo')} || '</h1><p>' || {_esc('language')} || '</p><ul>' || {_tile_sql} || '</ul>' AS html FROM st"),
    "html_sections": (_sections, f"""SELECT 'repo' || (page_id % 9) AS repo, page_id AS place, '<section><h2>' || {_esc('title')} || CASE WHEN n > 0 THEN ' <b class="badge">' || n || '</b>' ELSE '' END || '</h2>' || CASE WHEN trim(body) <> '' THEN '<pre>' || {_esc('body')} || '</pre>' ELSE '<p><em>No findings or report unavailable.</em></p>' END || '</section>' AS html
FROM (SELECT page_id, {duck.pick(catalog.REPORT_SECTIONS, 'page_id')} AS title, CASE WHEN page_id % 4 = 0 THEN '  ' ELSE html END AS body, CASE WHEN page_id % 3 = 0 THEN -1 ELSE page_id % 5 END AS n FROM pages)"""),
    "html_findings": (lambda s, d: O.html_findings(findings(s, d).withColumn("title", F.coalesce("title", F.lit("")))), f"""WITH {FINDINGS} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY {RANK}, id) AS place, '<tr><td style="background:' || {_colors} || '">' || severity || '</td><td>' || {_esc("coalesce(title, '')")} || '</td><td>' || {_esc(PLACE)} || '</td><td>' || {_esc('description')} || '</td></tr>' AS html FROM f"""),
    "html_page": (_page, f"""WITH {FINDINGS}, l AS (SELECT repo, 0 AS s, 0 AS n, '<!doctype html><html><head><meta charset="utf-8"><title>' || {_esc('repo')} || '</title></head><body>' AS html FROM (SELECT DISTINCT repo FROM f)
  UNION ALL SELECT repo, 1, 0, '<h1>' || {_esc('repo')} || '</h1><p>python</p><ul>' || {" || ".join(f"'<li><b>' || count(*) FILTER (WHERE severity = '{x}') || '</b> {c}</li>'" for c, x in zip(O.TILES, catalog.SEVERITIES, strict=True))} || '<li><b>' || count(*) || '</b> findings</li></ul>' FROM f GROUP BY repo
  UNION ALL SELECT source, 2, doc_id, '<section><h2>' || {_esc('title')} || CASE WHEN doc_id % 5 > 1 THEN ' <b class="badge">' || (doc_id % 5 - 1) || '</b>' ELSE '' END || '</h2>' || CASE WHEN trim(text) <> '' THEN '<pre>' || {_esc('text')} || '</pre>' ELSE '<p><em>No findings or report unavailable.</em></p>' END || '</section>' FROM (SELECT *, {duck.pick(catalog.REPORT_SECTIONS, 'doc_id')} AS title FROM documents)
  UNION ALL SELECT DISTINCT repo, 3, 0, '<table><tr><th>Severity</th><th>Title</th><th>Place</th><th>Description</th></tr>' FROM f
  UNION ALL SELECT repo, 4, row_number() OVER (PARTITION BY repo ORDER BY {RANK}, id), '<tr><td style="background:' || {_colors} || '">' || severity || '</td><td>' || {_esc("coalesce(title, '')")} || '</td><td>' || {_esc(PLACE)} || '</td><td>' || {_esc('description')} || '</td></tr>' FROM f
  UNION ALL SELECT DISTINCT repo, 5, 0, '</table></body></html>' FROM f) SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY s, n) AS place, html FROM l"""),
    "severity_lines": (lambda s, d: O.severity_lines(findings(s, d)), f"WITH {FINDINGS} SELECT repo, 'Total findings : ' || count(*) || '  (' || " + " || ' · ' || ".join(f"'{x}: ' || count(*) FILTER (WHERE severity = '{x}')" for x in catalog.SEVERITIES) + " || ')' AS line, count(*) FILTER (WHERE severity <> 'INFO') AS actionable FROM f GROUP BY repo"),
    "numbered_findings": (lambda s, d: O.numbered_findings(findings(s, d)), f"WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS place FROM f) SELECT repo, place, '  [' || place || '] [' || severity || '] ' || coalesce(title, '(untitled)') || {NL} || '      Location: ' || CASE WHEN file = '' THEN '(repo-wide)' ELSE file || ':' || coalesce(line, 0) END || {NL} || '      Description: ' || description || {NL} || '      Recommendation: ' || coalesce(recommendation, '') AS block FROM n"),
    "validation_chars": (_validation_chars, "SELECT r.repo, (length(coalesce(review, '')) + 1200 + coalesce(texts, 0))::BIGINT AS chars FROM (SELECT source AS repo, max(text) AS review FROM documents GROUP BY source) r LEFT JOIN (SELECT source AS repo, sum(length(left(text, 8000)) + 100) AS texts FROM documents GROUP BY source) t ON t.repo = r.repo"),
    "validation_gate": (_gate, f"WITH {STATES}, c AS (SELECT round(sum(coalesce(k.c_custkey / 1024.0::DOUBLE, 0)), 6) AS total FROM st LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) k ON st.repo = 'r' || k.c_custkey WHERE error IS NULL) SELECT threshold, total, threshold <> -1 AND total >= threshold AS ask FROM c, (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (5.0::DOUBLE), (1e12::DOUBLE)) t(threshold)"),
    "exit_code": (_exit_codes, f"WITH {STATES} " + " UNION ALL ".join(f"SELECT '{n}' AS runs, CASE WHEN bool_or(error IS NOT NULL) THEN 2 WHEN bool_or(greatest(coalesce(flow, 0), coalesce(auth, 0), coalesce(bandit, 0)) > 0) THEN 1 ELSE 0 END AS code FROM st WHERE {w}" for n, w in RUNS.items())),
    "next_step": (lambda s, d: O.next_step(states(s, d)), f"WITH {STATES} SELECT repo, CASE WHEN coalesce(offline, false) OR NOT coalesce(ai, true) THEN 'end' ELSE 'review' END AS step FROM st"),
    "allowed_reads": (lambda s, d: O.allowed_reads(_log(s, d)).select("session", "seq", "path", "allowed"), "WITH l AS (SELECT user_id AS session, event_id AS seq, 'src/f' || (event_id % 23) AS path FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY seq) <= 2 AS ok FROM l) SELECT session, seq, path, ok AND sum(ok::INT) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) <= 30 AS allowed FROM n"),
    "call_lines": (lambda s, d: O.call_line(O.call_counts(_log(s, d))), "SELECT session, string_agg(tool || ' ×' || n, ', ' ORDER BY tool) AS calls FROM (SELECT user_id AS session, event_type AS tool, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY session"),
}
