"""Relational plans in SQL that Spark and DuckDB both run; ``Dialect`` holds the few spellings that differ.

Views over the driver's tables stand in for an assessment's own: documents are findings, labels are verdicts, benchmark items are discoveries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import catalog
from ..functions.text import head_and_tail
from ..operators import reports, review
from ..sources import corpus
from .duck import q


@dataclass(frozen=True)
class Dialect:
    spark: bool
    sf_dir: str = ""

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`" if self.spark else name

    def q(self, s: str) -> str:
        return "'" + (s.replace("\\", "\\\\").replace("'", "\\'") if self.spark else s.replace("'", "''")) + "'"

    def array(self, values: list[str]) -> str:
        inner = ", ".join(self.q(v) for v in values)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def pick(self, values: list[str], n: str) -> str:
        return f"element_at({self.array(values)}, CAST({n} % {len(values)} AS INT) + 1)" if self.spark else f"{self.array(values)}[({n} % {len(values)}) + 1]"

    def like(self, s: str, p: str) -> str:
        return f"({s} RLIKE {self.q(p)})" if self.spark else f"regexp_matches({s}, {self.q(p)})"

    def part(self, s: str, p: str, g: int) -> str:
        return f"regexp_extract({s}, {self.q(p)}, {g})"

    def sub(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, {self.q(p)}, {self.q(r)})" if self.spark else f"regexp_replace({s}, {self.q(p)}, {self.q(r)}, 'g')"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def div(self, a: str, n: int) -> str:
        return f"({a} DIV {n})" if self.spark else f"({a} // {n})"

    def folders_hit(self, path: str) -> str:
        if self.spark:
            return f"arrays_overlap(slice(split(lower({path}), '/'), 1, size(split({path}, '/')) - 1), {self.array(catalog.EXCLUDED_FOLDERS)})"
        return f"list_has_any(string_split(lower({path}), '/')[:-2], {self.array(catalog.EXCLUDED_FOLDERS)})"

    def concat_agg(self, x: str, sep: str, order: str) -> str:
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order}, {x} AS x))), s -> s.x), {self.q(sep)})"
        return f"string_agg({x}, {self.q(sep)} ORDER BY {order})"


def views(d: Dialect) -> dict[str, str]:
    name = d.part("file", r"([^/]*)$", 1)
    severity = [*catalog.SEVERITIES, "ODD"]
    rank = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(catalog.SEVERITIES)) + " ELSE 9 END"
    prices = " UNION ALL ".join(f"SELECT {d.q(m)} AS model, CAST({a} AS DOUBLE) AS input_price, CAST({b} AS DOUBLE) AS output_price" for m, a, b in catalog.PRICES)
    url = f"""concat(url, {d.pick(['', '/tree/v1.1/src', '/blob/main/f.py', '@v2.0', '/issues/4', '.git@main', '/', '/commit/abc123?x=1', '/pulls'], 'page_id')})"""
    return {
        "paths": f"""SELECT doc_id, source AS repo, concat({d.pick(corpus.FOLDERS, 'doc_id')}, '/', {d.pick(corpus.STEMS, '(doc_id + ' + d.div('doc_id', 6) + ')')}, {d.text('doc_id')}, {d.pick(corpus.ENDINGS, d.div('doc_id', 5))}) AS file, text AS content, n_chars FROM {d.t('documents')}""",
        "named": f"SELECT *, {name} AS name, lower({d.part(name, r'[^.](\.[^.]*)$', 1)}) AS ending, {d.folders_hit('file')} AS excluded, ({d.like(name, catalog.TEST_FILE)} OR {d.like(name, catalog.EXAMPLE_FILE)}) AS is_test FROM paths",
        "findings": f"""SELECT source AS repo, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id, {d.pick(severity, 'doc_id')} AS severity, concat('Finding <', {d.text('doc_id')}, '>') AS title,
            concat('src/f', {d.text('doc_id % 50')}, '.py') AS file, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 400 END AS line, substring(text, 1, 80) AS description FROM {d.t('documents')}""",
        "verdicts": f"""SELECT f.repo, f.id, CASE WHEN l.toxic = 1 THEN 'severity_changed' WHEN l.quality = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict, CASE WHEN l.toxic = 1 THEN 'CRITICAL' END AS new_severity,
            concat('Evidence ', {d.text('l.doc_id')}, '. More of it.') AS evidence FROM {d.t('labels')} l JOIN findings f ON f.doc_id = l.doc_id""",
        "discovered": f"SELECT concat('src', {d.text('item_id % 20')}) AS repo, item_id, {d.pick(severity, 'item_id')} AS severity, concat('New ', {d.text('item_id')}) AS title, 'src/new.py' AS file, item_id % 90 AS line FROM {d.t('benchmark')}",
        "merged": """SELECT f.repo, f.id, coalesce(CASE WHEN v.verdict = 'severity_changed' THEN v.new_severity END, f.severity) AS severity, f.title, f.file, f.line, coalesce(v.verdict, 'confirmed') AS verdict, coalesce(v.evidence, '') AS evidence, f.severity AS original_severity
            FROM findings f LEFT JOIN verdicts v ON v.repo = f.repo AND v.id = f.id WHERE coalesce(v.verdict, 'confirmed') <> 'false_positive'
            UNION ALL SELECT repo, 1000000 + item_id, severity, title, file, line, 'discovered', '', NULL FROM discovered""",
        "ranked": f"SELECT *, {rank} AS severity_rank FROM merged",
        "prices": prices,
        "urls": f"SELECT page_id, {url} AS url FROM {d.t('pages')}",
        "cut_urls": f"SELECT page_id, url, {d.sub('trim(url)', '/+$', '')} AS u FROM urls",
        "at_urls": f"SELECT page_id, url, CASE WHEN {d.like('u', '^[a-z]+://[^/]+/.*@[^@]*$')} THEN {d.part('u', '^([a-z]+://[^/]+/.*)@([^@]*)$', 1)} ELSE u END AS u, nullif({d.part('u', '^([a-z]+://[^/]+/.*)@([^@]*)$', 2)}, '') AS r FROM cut_urls",
        "parsed": f"""SELECT page_id, url, {d.sub('''CASE WHEN t <> '' THEN b ELSE u END''', '/(releases|actions|issues|pull|pulls|wiki|discussions)(/.*)?$', '')} AS base, coalesce(r, nullif(t, '')) AS ref
            FROM (SELECT *, {d.part('u', '^(.*?)/(tree|blob|commit)/([^/?#]+).*$', 1)} AS b, {d.part('u', '^(.*?)/(tree|blob|commit)/([^/?#]+).*$', 3)} AS t FROM at_urls) x""",
        "repos": "SELECT repo, count(*) AS n_findings, sum(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END) AS n_high FROM findings GROUP BY repo",
        "review": "SELECT repo, sum(n_chars) AS chars, greatest(1, CAST(floor(CAST(sum(n_chars) AS DOUBLE) / 3.5) AS BIGINT)) AS tokens, count(*) AS n_files FROM paths GROUP BY repo",
    }


def counts_of(d: Dialect, js: list[str]) -> str:
    return f"sum(CASE WHEN ending = '.py' THEN 1 ELSE 0 END) AS py, sum(CASE WHEN ending IN ({', '.join(d.q(e) for e in js)}) THEN 1 ELSE 0 END) AS js"


def bodies(d: Dialect) -> dict[str, tuple[list[str], str]]:
    big = "CAST({} AS BIGINT)".format
    cost = "round(CAST(tokens AS DOUBLE) / 1000000.0 * input_price + 4096.0 / 1000000.0 * output_price, 6)"
    esc = "title"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        esc = f"replace({esc}, {d.q(a)}, {d.q(b)})"
    where = "CASE WHEN line IS NULL THEN file ELSE concat(file, ':', " + d.text("line") + ") END"
    last = d.part("base", r"([^/]+)/*$", 1)
    owner = d.part("base", r"([^/]+)/[^/]+/*$", 1)
    safe = d.sub("ref", r"[^A-Za-z0-9_.\-]", "_")
    finding = ["findings", "verdicts", "discovered", "merged", "ranked"]
    parse = ["urls", "cut_urls", "at_urls", "parsed"]
    flow = ["paths", "named"]
    return {
        "skip_paths": (flow, "SELECT doc_id, file, excluded OR is_test AS skipped FROM named"),
        "test_files": (flow, "SELECT doc_id, name FROM named WHERE is_test"),
        "source_scan": (flow, f"SELECT repo, file, {big('length(content)')} AS chars FROM named WHERE ending IN ({', '.join(d.q(e) for e in catalog.SOURCE_EXTENSIONS)}) AND NOT excluded AND NOT is_test AND length(content) > 0"),
        "list_dir": (flow, "SELECT repo, file FROM named WHERE file LIKE 'src/%' ORDER BY repo, file LIMIT 300"),
        "language_pipeline": (flow, f"SELECT repo, {big('py')} AS py, {big('js')} AS js, CASE WHEN js > py THEN 'js' WHEN py > js THEN 'python' ELSE 'unknown' END AS language FROM (SELECT repo, {counts_of(d, ['.js', '.ts', '.jsx', '.tsx'])} FROM named WHERE file NOT LIKE 'node_modules/%' GROUP BY repo) x"),
        "language_flow": (flow, f"SELECT repo, {big('py')} AS py, {big('js')} AS js, CASE WHEN js > py THEN 'js' ELSE 'python' END AS language FROM (SELECT repo, {counts_of(d, catalog.JS_EXTENSIONS)} FROM named WHERE NOT excluded AND NOT is_test GROUP BY repo) x"),
        "language_v2": (flow, f"SELECT repo, CASE WHEN js > py THEN 'js' WHEN py > 0 THEN 'python' ELSE 'none' END AS language FROM (SELECT repo, {counts_of(d, catalog.JS_EXTENSIONS)} FROM named WHERE NOT excluded AND NOT is_test GROUP BY repo) x"),
        "parse_url": (parse, "SELECT page_id, url, base, ref FROM parsed"),
        "repo_name": (parse, f"SELECT page_id, concat({owner}, '_', {d.sub(last, r'\.git$', '')}, CASE WHEN ref IS NULL THEN '' ELSE concat('@', {safe}) END) AS name FROM parsed"),
        "skip_done": (parse, f"SELECT p.page_id, p.base FROM parsed p WHERE NOT EXISTS (SELECT 1 FROM parsed o WHERE o.base = p.base AND o.page_id % 3 = 0)"),
        "verdict_counts": (["findings", "verdicts"], "SELECT repo, verdict, count(*) AS n FROM verdicts GROUP BY repo, verdict"),
        "unvalidated": (["findings", "verdicts"], f"SELECT f.repo, {big('f.id')} AS id, coalesce(v.verdict, 'not validated') AS verdict FROM findings f LEFT JOIN verdicts v ON v.repo = f.repo AND v.id = f.id"),
        "severity_groups": (finding, f"SELECT repo, severity, title, {big('row_number() OVER (PARTITION BY repo ORDER BY severity_rank, id, title)')} AS n, {big('count(*) OVER (PARTITION BY repo, severity)')} AS in_group FROM ranked"),
        "merged_findings": (finding, f"SELECT repo, {big('id')} AS id, severity, title, file, {big('line')} AS line, verdict, evidence, original_severity FROM merged"),
        "severity_histogram": (finding, f"SELECT severity, {big('count(*)')} AS n, {big('''sum(CASE WHEN severity = 'INFO' THEN 0 ELSE 1 END)''')} AS actionable FROM merged GROUP BY severity"),
        "top5": (finding, f"SELECT repo, {big('id')} AS id, severity, title FROM ranked ORDER BY severity_rank, repo, id LIMIT 5"),
        "high_only": (finding, f"SELECT repo, {big('id')} AS id, severity, title FROM merged WHERE severity IN ('CRITICAL', 'HIGH')"),
        "first_sentence": (finding, f"SELECT repo, {big('id')} AS id, {d.part('evidence', r'^(.*?)(\. |\n|$)', 1)} AS evidence, {where} AS place FROM merged"),
        "token_estimate": ([], f"SELECT doc_id, greatest(1, CAST(floor(CAST(n_chars AS DOUBLE) / 3.5) AS BIGINT)) AS tokens FROM {d.t('documents')}"),
        "review_cost": (["paths", "review", "prices"], f"SELECT model, {big('sum(tokens)')} AS input_tokens, {big('4096 * count(*) * 2')} AS output_tokens, round(CAST(sum(tokens) AS DOUBLE) / 1000000.0 * max(input_price) + CAST(4096 * count(*) * 2 AS DOUBLE) / 1000000.0 * max(output_price), 6) AS dollars FROM review CROSS JOIN prices GROUP BY model"),
        "validation_cost": (["paths", "review", "prices"], f"SELECT repo, model, {big('tokens')} AS tokens, {cost} AS dollars FROM review JOIN prices ON model = 'gpt-4o'"),
        "unknown_model": (["paths", "review", "prices"], f"SELECT repo, coalesce(input_price, 0.0) AS input_price FROM review LEFT JOIN prices ON model = concat('gpt-', repo)"),
        "excerpts": (["paths"], f"SELECT file, CASE WHEN length(content) <= 8000 THEN content ELSE concat(left(content, 8000), '[...]') END AS excerpt FROM paths"),
        "repo_summary": (["findings", "repos"], f"SELECT repo, {big('n_findings')} AS n_findings, {big('n_high')} AS n_high, CASE WHEN n_high = 0 THEN '-' ELSE {d.text('n_high')} END AS shown, greatest(length(repo), 28) AS width FROM repos"),
        "risky_repos": (["findings", "repos"], f"SELECT repo, {big('n_high')} AS n_high, {big('row_number() OVER (ORDER BY n_high DESC, repo)')} AS place FROM repos WHERE n_high > 0"),
        "html_rows": (finding, f"SELECT repo, {big('id')} AS id, concat('<tr><td>', severity, '</td><td>', {esc}, '</td><td>', {where}, '</td></tr>') AS html FROM merged"),
        "report_blocks": (finding, f"SELECT repo, {d.concat_agg('block', '---', 'severity_rank, id, title')} AS report FROM (SELECT repo, severity_rank, id, title, concat('[', severity, '] ', title, ' File : ', {where}) AS block FROM ranked WHERE verdict <> 'confirmed') x GROUP BY repo"),
        "findings_union": (finding, f"SELECT 'original' AS module, repo, {big('id')} AS id FROM findings UNION ALL SELECT 'discovered', repo, {big('item_id')} FROM discovered"),
        "sorted_findings": (finding, f"SELECT repo, title, {big('row_number() OVER (ORDER BY severity_rank, file, coalesce(line, 0), repo, id)')} AS place FROM ranked"),
        "last_verdict": (["findings", "verdicts"], f"SELECT repo, {big('id')} AS id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY seq DESC) AS n FROM (SELECT repo, id, verdict, 1 AS seq FROM verdicts UNION ALL SELECT repo, id, 'confirmed', 2 FROM verdicts WHERE id % 3 = 0) x) y WHERE n = 1"),
        "scanner_route": (["paths", "named"], "SELECT repo, CASE WHEN js > py THEN 'js rules' WHEN py > js THEN 'python rules' ELSE 'none' END AS scanner FROM (SELECT repo, " + counts_of(d, [".js", ".ts", ".jsx", ".tsx"]) + " FROM named GROUP BY repo) x"),
        "guardrails": (finding, f"""SELECT f.repo, CASE WHEN n_verdicts < n_findings THEN concat('Only ', {d.text('n_verdicts')}, '/', {d.text('n_findings')}, ' findings received a verdict') END AS missing, n_verdicts = n_findings AND n_false = n_verdicts AND n_new = 0 AS all_dismissed
            FROM (SELECT repo, count(*) AS n_findings FROM findings GROUP BY repo) f
            JOIN (SELECT repo, count(*) AS n_verdicts, sum(CASE WHEN verdict = 'false_positive' THEN 1 ELSE 0 END) AS n_false FROM verdicts GROUP BY repo) v ON v.repo = f.repo
            LEFT JOIN (SELECT repo, count(*) AS n_new FROM discovered GROUP BY repo) n ON n.repo = f.repo"""),
    }


def sql(name: str, d: Dialect) -> str:
    need, body = bodies(d)[name]
    have = views(d)
    if "WITH" in body[:5]:
        return body
    head = ",\n".join(f"{v} AS ({have[v]})" for v in need)
    return f"WITH {head}\n{body}" if need else body


DUCK = Dialect(spark=False)
QUERIES = {name: ((lambda spark, sf_dir, name=name: spark.sql(sql(name, Dialect(True, sf_dir)))), sql(name, DUCK)) for name in bodies(DUCK)}


def _view(spark: SparkSession, sf_dir: str, need: list[str], body: str) -> DataFrame:
    have = views(Dialect(True, sf_dir))
    return spark.sql("WITH " + ", ".join(f"{v} AS ({have[v]})" for v in need) + " " + body)


def _sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in one order, without one task for all."""
    found = _view(spark, sf_dir, ["findings", "verdicts", "discovered", "merged", "ranked"], "SELECT repo, title, severity_rank, file, coalesce(line, 0) AS line, id FROM ranked")
    return shared.ranked(found, [F.col(c) for c in ("severity_rank", "file", "line", "repo", "id")], "place").select("repo", "title", "place")


def _risky_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _view(spark, sf_dir, ["findings", "repos"], "SELECT repo, CAST(n_high AS BIGINT) AS n_high FROM repos WHERE n_high > 0")
    return shared.ranked(found, [F.col("n_high").desc(), F.col("repo")], "place").select("repo", "n_high", "place")


QUERIES["sorted_findings"] = (_sorted_findings, QUERIES["sorted_findings"][1])
QUERIES["risky_repos"] = (_risky_repos, QUERIES["risky_repos"][1])


def _prompt_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is in one of the six sections of its repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.coalesce(F.pmod("doc_id", F.lit(len(catalog.REPORT_SECTIONS))), F.lit(0))
    return review.prompt_size(docs.select(F.col("source").alias("repo"), place.alias("place"), "text"))


_titles = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(catalog.REPORT_SECTIONS))
_mark = "chr(10) || chr(10) || '...[TRUNCATED]...' || chr(10) || chr(10)"
PROMPT_SIZE = f"""WITH d AS (SELECT source AS repo, coalesce((doc_id % 6 + 6) % 6, 0) AS k, coalesce(text, '') AS text FROM documents),
b AS (SELECT repo, k, string_agg(text, chr(10)) AS body FROM d GROUP BY repo, k),
s AS (SELECT title, k, repo FROM (VALUES {_titles}) t(title, k) CROSS JOIN (SELECT DISTINCT repo FROM d))
SELECT s.repo, CAST(800 + sum(length('## ' || title || chr(10) || chr(10) || CASE WHEN body IS NULL OR NOT regexp_matches(body, '\\S') THEN '(No findings or report unavailable.)'
  WHEN length(body) > 120000 THEN left(body, 84000) || {_mark} || right(body, 36000) ELSE body END || chr(10))) AS BIGINT) AS chars
FROM s LEFT JOIN b ON b.repo IS NOT DISTINCT FROM s.repo AND b.k = s.k GROUP BY s.repo"""
QUERIES["prompt_size"] = (_prompt_size, PROMPT_SIZE)


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a report shows them: whole up to 60,000 characters."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", head_and_tail(F.col("text"), 60_000, catalog.CUT_MARK).alias("excerpt"))


QUERIES["truncate_70_30"] = (_truncated, f"SELECT doc_id, CASE WHEN length(text) <= 60000 THEN text ELSE left(text, 42000) || {_mark} || right(text, 18000) END AS excerpt FROM documents")


def _cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the validation of all repositories has to be confirmed, at the default threshold."""
    costs = spark.sql(sql("validation_cost", Dialect(True, sf_dir))).select(F.col("dollars").alias("cost"))
    return reports.ask_first(costs, catalog.CONFIRM_ABOVE).select(F.round("total", 6).alias("total"), "ask")


QUERIES["cost_gate"] = (_cost_gate, f"SELECT round(coalesce(sum(dollars), 0.0), 6) AS total, coalesce(sum(dollars), 0.0) >= 5.0 AS ask FROM ({sql('validation_cost', DUCK)})")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda name: _view(spark, sf_dir, ["findings", "verdicts", "discovered"], f"SELECT * FROM {name}")
    big = lambda df: df.withColumn("line", F.col("line").cast("long"))
    findings = big(view("findings")).select("repo", F.col("id").cast("long").alias("id"), "severity", "title", "file", "line")
    discovered = big(view("discovered")).select("repo", (F.lit(1_000_000) + F.col("item_id")).cast("long").alias("id"), "severity", "title", "file", "line")
    return review.merge_verdicts(findings, view("verdicts").withColumn("seq", F.lit(1)), discovered)


QUERIES["merged_findings"] = (_merged, QUERIES["merged_findings"][1])


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a list: urls with spaces around them, comments, blank lines."""
    url = _view(spark, sf_dir, ["urls"], "SELECT page_id, url FROM urls")
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    return url.select("page_id", line.alias("value"))


QUERIES["batch_urls"] = (lambda spark, sf_dir: corpus.list_entries(_urls(spark, sf_dir)), f"WITH urls AS ({views(DUCK)['urls']}) SELECT page_id, trim(url) AS url FROM urls WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _view(spark, sf_dir, ["urls", "cut_urls", "at_urls", "parsed"], "SELECT page_id, base AS url FROM parsed")
    return review.merged_progress(base.where("page_id % 3 = 0"), base.where("page_id % 4 = 0"))


QUERIES["progress_upsert"] = (_progress, "WITH " + ", ".join(f"{v} AS ({views(DUCK)[v]})" for v in ("urls", "cut_urls", "at_urls", "parsed")) + " SELECT base AS url FROM parsed WHERE page_id % 3 = 0 AND base IS NOT NULL UNION SELECT base FROM parsed WHERE page_id % 4 = 0 AND base IS NOT NULL")
