"""Reviews: AI replies and their checks, report texts and mentions, prompts, and the writers of reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import head_and_tail, severity_rank
from .store import Versioned

REVIEW = "summary string, findings array<struct<id:long,severity:string,title:string,file:string,line:long,description:string,recommendation:string>>"
VERDICTS = "canary string, summary string, validated_findings array<struct<id:long,original_severity:string,verdict:string,new_severity:string,evidence:string,file:string,line:long>>, new_findings array<struct<severity:string,title:string,file:string,line:long,description:string,recommendation:string>>"


def strip_fence(reply: Column) -> Column:
    """The reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z0-9_]*\n?", ""), r"\n?```$", ""))


def parse_review(replies: DataFrame) -> DataFrame:
    """replies (id, reply) -> (id, summary, findings); what is no JSON object becomes a summary of its first 500 characters."""
    body = strip_fence(F.col("reply"))
    parsed = F.when(F.startswith(F.ltrim(body), F.lit("{")), F.from_json(body, REVIEW, {"mode": "PERMISSIVE"}))
    good = parsed.isNotNull() & (parsed["summary"].isNotNull() | parsed["findings"].isNotNull())
    return replies.select("id", F.when(good, F.coalesce(parsed["summary"], F.lit(""))).otherwise(F.left(F.col("reply"), F.lit(500))).alias("summary"), F.when(good, F.coalesce(parsed["findings"], F.array())).otherwise(F.array()).alias("findings"))


def repair_json(text: str) -> tuple[str | None, bool]:
    """(JSON, was it repaired): cuts a truncated reply back to its last complete value and closes what is open."""
    try:
        json.loads(text)
        return text, False
    except ValueError as e:
        most = _longest(e, len(text))
    opened: list[str] = []
    safe: list[tuple[int, str]] = []  # places where the text may end, with what closes it
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            escaped = c == "\\" and not escaped
            quoted = c != '"' or (i and text[i - 1] == "\\" and _odd_backslashes(text, i))
            if not quoted:
                safe.append((i + 1, "".join(reversed(opened))))
        elif c == '"':
            quoted = True
        elif c in "{[":
            opened.append("}" if c == "{" else "]")
            safe.append((i + 1, "".join(reversed(opened))))
        elif c in "}]" and opened:
            opened.pop()
            safe.append((i + 1, "".join(reversed(opened))))
        elif c.isalnum():
            safe.append((i + 1, "".join(reversed(opened))))
    for end, close in reversed(safe):
        if end > most:
            continue
        try:
            json.loads(text[:end] + close)
            return text[:end] + close, True
        except ValueError as e:
            most = min(most, _longest(e, len(text)))
    return None, True


def _longest(error: ValueError, most: int) -> int:
    """No longer beginning of the text parses: it would hold the same error.  16 is more than a literal that is still incomplete at the error's place."""
    return error.pos + 16 if isinstance(error, json.JSONDecodeError) else most


def _odd_backslashes(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def check_replies(replies: DataFrame) -> DataFrame:
    """replies (id, reply, canary, expected) -> (id, verdicts, problems): the guardrails of a validation reply."""

    @F.pandas_udf("fixed string, repaired boolean")
    def repair(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair_json(t or "") for t in text], columns=["fixed", "repaired"])

    r = replies.withColumn("_r", repair(strip_fence(F.col("reply")))).withColumn("_o", F.startswith(F.ltrim("_r.fixed"), F.lit("{")))
    r = r.withColumn("v", F.when(F.col("_o"), F.from_json("_r.fixed", VERDICTS)))
    n = F.coalesce(F.size("v.validated_findings"), F.lit(0))
    none_new = F.coalesce(F.size("v.new_findings"), F.lit(0)) == 0
    lists = lambda c: F.get_json_object("_r.fixed", f"$.{c}")
    no_list = lambda c: F.col("_o") & lists(c).isNotNull() & ~F.startswith(lists(c), F.lit("["))
    dismissed = (F.col("expected") > 0) & (n == F.col("expected")) & none_new & F.coalesce(F.forall("v.validated_findings", lambda x: x["verdict"] == "false_positive"), F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(F.col("_r.fixed").isNull(), "malformed"), F.when(F.col("_r.fixed").isNotNull() & F.col("_r.repaired"), "truncated"), F.when(F.col("_r.fixed").isNotNull() & ~F.col("_o"), "not an object"),
            F.when(F.col("_o") & ~F.col("v.canary").eqNullSafe(F.col("canary")), "canary mismatch"), F.when(no_list("validated_findings"), "verdicts are no array"), F.when(no_list("new_findings"), "new findings are no array"),
            F.when(F.col("_o") & (n < F.col("expected")), F.concat(F.lit("only "), n.cast("string"), F.lit("/"), F.col("expected").cast("string"), F.lit(" verdicts"))), F.when(F.col("_o") & dismissed, "all dismissed"),
        )
    )
    return r.select("id", F.col("v").alias("verdicts"), problems.alias("problems"))


def merge_verdicts(findings: DataFrame, verdicts: DataFrame, new: DataFrame, default: str = "confirmed") -> DataFrame:
    """findings (repo, id, severity, title, file, line) with their verdicts (the last of an id counts), false positives dropped, discoveries added; new may have ids, too."""
    last = verdicts.groupBy("repo", "id").agg(F.max_by(F.struct("verdict", "new_severity", "evidence"), "seq").alias("v")).select("repo", "id", "v.*")
    both = findings.join(last, ["repo", "id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).where("verdict <> 'false_positive'")
    changed = F.when((F.col("verdict") == "severity_changed") & F.col("new_severity").isNotNull(), F.col("new_severity")).otherwise(F.col("severity"))
    kept = both.select("repo", "id", changed.alias("severity"), "title", "file", "line", "verdict", F.coalesce("evidence", F.lit("")).alias("evidence"), F.col("severity").alias("original_severity"))
    number = F.col("id") if "id" in new.columns else F.lit(None).cast("long")
    return kept.unionByName(new.withColumns({"id": number, "verdict": F.lit("discovered"), "evidence": F.lit(""), "original_severity": F.lit(None).cast("string")}).select(kept.columns))


def mentions(reports: DataFrame, files: DataFrame) -> DataFrame:
    """reports (repo, report) -> (repo, file, place): source files named in a report that exist, each once, in the order of their first mention."""
    label = F.transform(F.regexp_extract_all("report", F.lit("(?d)" + catalog.MENTION_LABEL), F.lit(1)), lambda p: F.regexp_replace(p, r":\d+$", ""))
    found = F.concat(label, *[F.regexp_extract_all("report", F.lit("(?d)" + p), F.lit(1)) for p in (catalog.MENTION_BRACKET, catalog.MENTION_LINE_START)])
    clean = F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(p, "^[\"']+|[\"']+$", "")), lambda p: F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1)).isin(catalog.SOURCE_EXTENSIONS)))
    return reports.select("repo", F.posexplode(clean).alias("place", "file")).join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi").select("repo", "file", F.col("place").cast("long").alias("place"))


def read_lines(files: DataFrame, start: int, end: int, most: int = 400) -> DataFrame:
    """Numbered lines start to end of each file, at most ``most`` of them."""
    last = min(end, start + most - 1)
    return files.select("repo", "file", F.posexplode(F.slice(F.split("content", "\n"), start, max(0, last - start + 1))).alias("i", "text")).select("repo", "file", (F.col("i") + start).cast("long").alias("line"), F.format_string("%5d | %s", (F.col("i") + start).cast("int"), F.col("text")).alias("shown"))


def review_prompt(sections: DataFrame, most: int = 120_000) -> DataFrame:
    """sections (repo, place, title, body) -> (repo, prompt), long bodies cut in the middle, empty ones with a default text."""
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", head_and_tail(F.col("body"), most)).otherwise(F.lit("(No findings or report unavailable.)"))
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), body, F.lit("\n"))
    return sections.select("repo", F.struct("place", part.alias("part")).alias("s")).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]), "\n").alias("prompt"))


def prompt_size(parts: DataFrame, most: int = 120_000) -> DataFrame:
    """parts (repo, place, text) -> (repo, chars): the size of a prompt of all report sections; the parts of a section are joined by line ends and cut above ``most``.

    Only lengths are added up, so no section is ever gathered in one row.
    """
    text = F.coalesce("text", F.lit(""))
    total = F.lit(catalog.PROMPT_OVERHEAD)
    for i, title in enumerate(catalog.REPORT_SECTIONS):
        here = F.col("place") == i
        chars = F.sum(F.when(here, F.length(text) + 1)) - 1
        written = F.coalesce(F.bool_or(here & text.rlike(r"\S")), F.lit(False))
        body = F.when(~written, len(catalog.NO_REPORT)).when(chars <= most, chars).otherwise(most + len(catalog.CUT_MARK))
        total = total + F.lit(len(f"## {title}\n\n\n")) + body
    return parts.groupBy("repo").agg(total.cast("long").alias("chars"))


def validation_prompt(prompts: DataFrame, canary: Column | None = None) -> DataFrame:
    """prompts (repo, prompt) inside a boundary that the text can't guess, with a canary to be returned."""
    boundary, token = F.uuid(), canary if canary is not None else F.uuid()
    p = prompts.withColumn("boundary", boundary).withColumn("canary", token)
    return p.select("repo", "canary", F.concat(F.lit("Return canary "), "canary", F.lit(".\n<<"), "boundary", F.lit(">>\n"), "prompt", F.lit("\n<</"), "boundary", F.lit(">>")).alias("prompt"))


def ask(prompts: DataFrame, provider: Callable[[str], str], stored: DataFrame | None = None) -> DataFrame:
    """(repo, reply) from an injected provider; its failures become replies that say so.  Where stored (repo, reply) has a reply, that one is taken and nobody is asked."""
    if stored is not None:
        known = stored.where(F.trim("reply") != "").groupBy("repo").agg(F.max("reply").alias("reply"))
        return prompts.select("repo").distinct().join(known, "repo").select("repo", "reply").unionByName(ask(prompts.join(known, "repo", "left_anti"), provider))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                try:
                    replies.append(provider(prompt))
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    replies.append(json.dumps({"summary": f"review failed: {e}", "findings": []}))
            yield pd.DataFrame({"repo": frame["repo"], "reply": replies})

    return prompts.select("repo", "prompt").mapInPandas(run, "repo string, reply string")


def report_text(findings: DataFrame, title: str) -> DataFrame:
    """(repo, report): a count and one block per finding, worst first."""
    place = F.when(F.col("line").isNull(), F.col("file")).otherwise(F.concat("file", F.lit(":"), F.col("line").cast("string")))
    block = F.concat(F.lit("["), "severity", F.lit("] "), "type", F.lit("\n  File : "), place)
    rows = findings.select("repo", F.struct(severity_rank(F.col("severity")).alias("r"), "file", F.coalesce("line", F.lit(0)).alias("l"), block.alias("b")).alias("s"))
    return rows.groupBy("repo").agg(F.concat(F.lit(f"{title}: "), F.count("*").cast("string"), F.lit(" finding(s)\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n\n")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder per repository with its report as text."""
    reports.select("repo", "report").write.mode("overwrite").partitionBy("repo").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merged_progress(done: DataFrame, new: DataFrame) -> DataFrame:
    """(url) of both, each once."""
    return done.select("url").union(new.select("url")).where("url IS NOT NULL").distinct()


def upsert_progress(spark: SparkSession, done: DataFrame, new: DataFrame, path: str) -> None:
    """Adds both url sets to the progress table at path, sorted.  The table before stays the current one until the new one is whole, and what another writer adds meanwhile is kept."""
    Versioned(spark, path, "url string").update(lambda now: merged_progress(now, done.select("url").union(new.select("url"))).orderBy("url"))
