"""Outputs of an assessment: report blocks, call trees, HTML pages, batch summaries, and the relations around costs and reads.

A report is a table of blocks or lines with their places, (repo, place, block), so a repository with millions of findings is never one row; ``write_lines``
stores them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import catalog
from ..functions.text import html_escape, severity_rank

DASH = "—"
TILES = ("flow", "network", "stream", "auth", "static")


def shown(count: Column) -> Column:
    """A count as text; a dash for null and -1, which stand for "not run"."""
    return F.when(count.isNull() | (count == -1), F.lit(DASH)).otherwise(count.cast("string"))


def location(file: Column, line: Column) -> Column:
    """``file:line``, the file alone without a line, and ``(repo-wide)`` without a file."""
    named = F.when(F.coalesce(line, F.lit(0)) == 0, file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))
    return F.when(F.coalesce(file, F.lit("")) == "", F.lit("(repo-wide)")).otherwise(named)


def worst_first(*more: str) -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("file"), F.coalesce("line", F.lit(0)), *map(F.col, more)]


def blocks(findings: DataFrame, fields: list[tuple[str, str]], order: list[Column]) -> DataFrame:
    """findings (repo, severity, type, file, line, ...) as (repo, place, block): a head and one line per (label, column) whose column is not null or empty."""
    width = max(len(label) for label, _ in fields)
    place = location(F.col("file"), F.col("line"))
    lines = [F.concat(F.lit("["), "severity", F.lit("] "), "type"), F.concat(F.lit("  " + "File".ljust(width) + ": "), place)]
    lines += [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {label.ljust(width)}: "), F.col(c).cast("string"))) for label, c in fields]
    return shared.ranked_within(findings, "repo", order, "place").select("repo", "place", F.concat_ws("\n", *lines).alias("block"))


def heads(findings: DataFrame, repos: DataFrame, found: str, none: str) -> DataFrame:
    """(repo, head): the first line of each repository's report, also where nothing was found."""
    n = repos.select("repo").distinct().join(findings.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left")
    return n.select("repo", F.when(F.col("n").isNull(), F.lit(none)).otherwise(F.concat(F.col("n").cast("string"), F.lit(found))).alias("head"))


def write_lines(report: DataFrame, path: str, text: str = "block", per_file: int = 100_000) -> DataFrame:
    """report (repo, place, text), places from 1: text files of ``per_file`` lines in one folder per repository and part, so a repository may be written by any number of tasks.

    Read in the order of their parts, a repository's files are its report.  The manifest, (repo, part, first, last, lines), is written beside them (``_manifest``) once they are whole, and returned.
    """
    spark = report.sparkSession
    part = F.format_string("%08d", F.floor((F.col("place") - 1) / per_file).cast("long"))
    cut = report.select("repo", "place", F.col(text).alias("_text"), part.alias("part"))
    ordered = cut.repartition("repo", "part").sortWithinPartitions("repo", "part", "place")
    ordered.select("repo", "part", "_text").write.mode("overwrite").partitionBy("repo", "part").text(path)
    manifest = cut.groupBy("repo", "part").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("lines"))
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def html_page(states: DataFrame, reports: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo, place, html): the whole page of every repository of states, piece by piece: head and tiles, the sections of reports, the table of findings, the end.  ``write_lines`` stores it."""
    at = lambda df, section, html, place=None: df.select("repo", F.lit(section).alias("_section"), (F.lit(0) if place is None else F.col(place)).cast("long").alias("_nth"), html.alias("html"))
    title = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), html_escape(F.col("repo")), F.lit("</title></head><body>"))
    known = states.select("repo").distinct()
    pieces = [
        at(known, 0, title), at(html_tiles(states), 1, F.col("html")), at(html_sections(reports), 2, F.col("html"), "place"), at(known, 3, F.lit("<table><tr><th>Severity</th><th>Title</th><th>Place</th><th>Description</th></tr>")),
        at(html_findings(findings), 4, F.col("html"), "place"), at(known, 5, F.lit("</table></body></html>")),
    ]
    page = pieces[0]
    for more in pieces[1:]:
        page = page.unionByName(more)
    return shared.ranked_within(page, "repo", [F.col("_section"), F.col("_nth")], "place").select("repo", "place", "html")


def stream_findings(ssrf: DataFrame, redirects: DataFrame, cors: DataFrame, origin: DataFrame) -> DataFrame:
    """All stream findings with their notes, one per (type, file, line)."""
    notes = F.create_map(*[F.lit(x) for pair in catalog.STREAM_NOTES.items() for x in pair])
    both = None
    for f in (ssrf, redirects, cors, origin):
        f = f.select("repo", "file", "line", "type", "severity", "match", notes[F.col("type")].alias("note"))
        both = f if both is None else both.unionByName(f)
    first = Window.partitionBy("repo", "type", "file", "line").orderBy("match")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def trace_results(nodes: DataFrame, counts: DataFrame, depth: int = 4) -> DataFrame:
    """counts (root, n) as (root, result): the closing line of each entry point's tree."""
    clean = F.lit(f"Result: CLEAN — no dangerous sinks reached within depth {depth}")
    return nodes.select("root").distinct().join(counts, "root", "left").select("root", F.when(F.coalesce("n", F.lit(0)) == 0, clean).otherwise(F.concat(F.lit("Result: "), F.col("n").cast("string"), F.lit(" sink(s) reached"))).alias("result"))


def project_types(files: DataFrame) -> DataFrame:
    """(repo, project) by the marker files at the repository's root; Python comes before Node."""
    has = lambda names: F.coalesce(F.bool_or(F.col("file").isin(names)), F.lit(False))
    flags = files.groupBy("repo").agg(has(catalog.PYTHON_MARKERS).alias("py"), has(catalog.NODE_MARKERS).alias("node"))
    return flags.select("repo", F.when(F.col("py"), "python").when(F.col("node"), "node").otherwise("unknown").alias("project"))


def healthy(states: DataFrame) -> DataFrame:
    """Runs that did not fail."""
    return states.where(F.col("error").isNull())


def summary_rows(states: DataFrame) -> DataFrame:
    """states (repo, language, flow, network, auth, bandit, semgrep, bandit_path, semgrep_path, review, error) with the static count and the texts of the summary table.

    The static count is that of both scanners; without findings it is 0, or -1 ("not run") if neither has written a report.
    """
    positive = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    both = positive("bandit") + positive("semgrep")
    unset = (F.coalesce("bandit_path", F.lit("")) == "") & (F.coalesce("semgrep_path", F.lit("")) == "")
    static = F.when(both > 0, both).when(unset, -1).otherwise(0).cast("long")
    reviewed = (F.coalesce("review", F.lit("")) != "") & ~F.contains(F.lower(F.coalesce("review", F.lit(""))), F.lit("disabled"))
    return states.select("repo", "language", *[shown(F.col(c)).alias(c) for c in ("flow", "network", "auth")], shown(static).alias("static"), F.when(reviewed, "✓").otherwise(DASH).alias("ai"), "error")


def summary_lines(states: DataFrame) -> DataFrame:
    """(repo, line) of the batch summary; the first column is as wide as the longest name, 28 at least, over all rows."""
    rows = summary_rows(states)
    width = rows.agg(F.greatest(F.coalesce(F.max(F.length("repo")), F.lit(0)), F.lit(28)).alias("width"))  # one row
    cells = [F.rpad("repo", F.col("width"), F.lit(" ")), F.rpad("language", F.lit(8), F.lit(" ")), *[F.lpad(c, F.lit(n), F.lit(" ")) for c, n in (("flow", 8), ("network", 7), ("auth", 4), ("static", 6), ("ai", 3))]]
    failed = F.concat(cells[0], F.lit("  ERROR: "), F.left("error", F.lit(60)))
    return rows.crossJoin(F.broadcast(width)).select("repo", F.when(F.col("error").isNotNull(), failed).otherwise(F.concat_ws("  ", *cells)).alias("line"))


def report_paths(states: DataFrame, columns: list[str]) -> DataFrame:
    """(repo, kind, path) of the reports that were written."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("path")) for c in columns])).alias("p")
    return states.select("repo", pairs).select("repo", "p.*").where(F.coalesce("path", F.lit("")) != "")


def html_sections(reports: DataFrame) -> DataFrame:
    """reports (repo, place, title, body, count) as (repo, place, html): a section with a badge where something was found and a default for empty bodies."""
    badge = F.when(F.col("count") > 0, F.concat(F.lit(' <b class="badge">'), F.col("count").cast("string"), F.lit("</b>"))).otherwise("")
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.concat(F.lit("<pre>"), html_escape(F.col("body")), F.lit("</pre>"))).otherwise(F.lit("<p><em>No findings or report unavailable.</em></p>"))
    return reports.select("repo", "place", F.concat(F.lit("<section><h2>"), html_escape(F.col("title")), badge, F.lit("</h2>"), body, F.lit("</section>")).alias("html"))


def html_tiles(states: DataFrame) -> DataFrame:
    """states (repo, language, flow, network, stream, auth, static, findings) as (repo, html): head and six tiles; what was not run counts as 0."""
    tiles = [F.concat(F.lit("<li><b>"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("string"), F.lit(f"</b> {c}</li>")) for c in (*TILES, "findings")]
    head = F.concat(F.lit("<h1>"), html_escape(F.col("repo")), F.lit("</h1><p>"), html_escape(F.col("language")), F.lit("</p><ul>"))
    return states.select("repo", F.concat(head, *tiles, F.lit("</ul>")).alias("html"))


def html_findings(findings: DataFrame) -> DataFrame:
    """findings (repo, id, severity, title, file, line, description) as (repo, place, html): rows of the findings table, worst first."""
    color = F.lit(catalog.SEVERITY_COLOR)
    for s, c in catalog.SEVERITY_COLORS.items():
        color = F.when(F.col("severity") == s, c).otherwise(color)
    cells = [F.concat(F.lit('<td style="background:'), color, F.lit('">'), html_escape(F.col("severity")), F.lit("</td>")), *[F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>")) for c in (F.col("title"), location(F.col("file"), F.col("line")), F.coalesce("description", F.lit("")))]]
    placed = shared.ranked_within(findings, "repo", [severity_rank(F.col("severity")), F.col("id")], "place")
    return placed.select("repo", "place", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def severity_lines(findings: DataFrame) -> DataFrame:
    """(repo, line, actionable): how many findings of each severity; INFO asks for nothing."""
    of = lambda s: F.count_if(F.col("severity") == s)
    counts = F.concat_ws(" · ", *[F.concat(F.lit(f"{s}: "), of(s).cast("string")) for s in catalog.SEVERITIES])
    return findings.groupBy("repo").agg(F.concat(F.lit("Total findings : "), F.count("*").cast("string"), F.lit("  ("), counts, F.lit(")")).alias("line"), F.count_if(F.coalesce("severity", F.lit("INFO")) != "INFO").alias("actionable"))


def numbered_findings(findings: DataFrame) -> DataFrame:
    """findings (repo, id, severity, title, file, line, description, recommendation) as (repo, place, block), numbered in order of id for a validator to refer to."""
    placed = shared.ranked_within(findings, "repo", [F.col("id")], "place")
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    place = F.when(text("file") == "", F.lit("(repo-wide)")).otherwise(F.concat("file", F.lit(":"), F.coalesce("line", F.lit(0)).cast("string")))
    block = F.concat(F.lit("  ["), F.col("place").cast("string"), F.lit("] ["), text("severity", "?"), F.lit("] "), text("title", "(untitled)"), F.lit("\n      Location: "), place, F.lit("\n      Description: "), text("description"), F.lit("\n      Recommendation: "), text("recommendation"))
    return placed.select("repo", "place", block.alias("block"))


def validation_chars(reviews: DataFrame, excerpts: DataFrame) -> DataFrame:
    """reviews (repo, review) and excerpts (repo, text) -> (repo, chars): the size of a validation prompt, each text with its frame."""
    texts = excerpts.groupBy("repo").agg(F.sum(F.length("text") + catalog.EXCERPT_OVERHEAD).alias("texts"))
    return reviews.join(texts, "repo", "left").select("repo", (F.length(F.coalesce("review", F.lit(""))) + catalog.VALIDATION_OVERHEAD + F.coalesce("texts", F.lit(0))).cast("long").alias("chars"))


def with_costs(states: DataFrame, costs: DataFrame) -> DataFrame:
    """states with their cost (repo, cost); 0 where none is known."""
    return states.join(costs.select("repo", "cost"), "repo", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def ask_first(costs: DataFrame, threshold: float | Column) -> DataFrame:
    """One row (total, ask): whether the total of costs (cost) has to be confirmed; a threshold of -1 never asks."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    total = F.coalesce(F.sum("cost"), F.lit(0.0))
    return costs.agg(total.alias("total")).select("total", ((limit != -1) & (F.col("total") >= limit)).alias("ask"))


def exit_code(states: DataFrame) -> DataFrame:
    """One row (code): 2 if a run failed, else 1 if one found something in the flow, the authorisation or the Python scanner, else 0."""
    found = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in ("flow", "auth", "bandit")]) > 0
    code = F.when(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)), 2).when(F.coalesce(F.bool_or(found), F.lit(False)), 1).otherwise(0)
    return states.agg(code.cast("int").alias("code"))


def next_step(states: DataFrame) -> DataFrame:
    """states (repo, offline, ai) as (repo, step): a review follows unless the run is offline or the module is off; an unset module is on."""
    off = F.coalesce("offline", F.lit(False)) | ~F.coalesce("ai", F.lit(True))
    return states.select("repo", F.when(off, "end").otherwise("review").alias("step"))


def allowed_reads(requests: DataFrame, per_path: int = 2, in_all: int = 30) -> DataFrame:
    """requests (session, seq, path) with ``allowed``: within a session the first ``per_path`` reads of a path count, and of those that count the first ``in_all``."""
    nth = F.row_number().over(Window.partitionBy("session", "path").orderBy("seq"))
    counted = requests.withColumn("_ok", nth <= per_path)
    running = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("allowed", F.col("_ok") & (running <= in_all)).drop("_ok")


def call_counts(log: DataFrame) -> DataFrame:
    """log (session, tool) as (session, tool, n) and, as one text per session, ``search ×2, ...`` by call_line."""
    return log.groupBy("session", "tool").agg(F.count("*").alias("n"))


def call_line(counts: DataFrame) -> DataFrame:
    """counts (session, tool, n): one text per session; a session has a bounded number of tools."""
    each = F.struct("tool", F.concat("tool", F.lit(" ×"), F.col("n").cast("string")).alias("t"))
    return counts.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), ", ").alias("calls"))
