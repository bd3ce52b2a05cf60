"""Pattern scans: files x catalogue -> findings, in one pass over the files with literal patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import MARK, any_marker, extension, file_name, lits, match_structs

COMMENT = r"^\s*(#|//)"
COMMENT_JS = r"^\s*(//|\*)"


def all_matches(files: DataFrame, patterns: list[tuple], severity: str = "HIGH", keep: tuple[str, ...] = ()) -> DataFrame:
    """(repo, file, ordinal, idx, match, line, text, detail, severity) of every match, and the columns of keep; a pattern is (regex, detail[, severity])."""
    content = F.translate("content", MARK, "")
    found = [match_structs(F.col("content"), p[0], i, p[1], p[2] if len(p) > 2 else severity) for i, p in enumerate(patterns)]
    return files.select("repo", "file", *keep, content.alias("content")).select("repo", "file", *keep, F.inline(F.flatten(F.array(*found))))


def first_wins(findings: DataFrame, key: list[str]) -> DataFrame:
    """The first finding of each key, in the order of the catalogue and the matches."""
    w = Window.partitionBy(*key).orderBy("ordinal", "idx")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def finding(df: DataFrame, kind: Column, cut: int | None = 120) -> DataFrame:
    match = F.trim(F.col("match"))
    return df.select("repo", "file", F.col("line").cast("long").alias("line"), kind.alias("type"), "severity", (F.left(match, F.lit(cut)) if cut else match).alias("match"), "detail")


#: Modules of ``fused``: name -> (patterns, type, characters of a match that are shown, severity).  The last two look at stream files only and at comments, too.
FUSED = {
    "credentials": (catalog.CREDENTIALS, "HARDCODED_CREDENTIAL", 120, "HIGH"),
    "jwt": (catalog.JWT_MISUSE, "JWT_MISUSE", 120, "HIGH"),
    "authz": (catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS", 120, "HIGH"),
    "session": (catalog.INSECURE_SESSION, "INSECURE_SESSION", 120, "HIGH"),
    "ssrf": ([(p, "") for p in catalog.STREAM_SSRF], "SSRF_STREAM", 120, "MEDIUM"),
    "redirect": ([(p, "") for p in catalog.REDIRECTS], "OPEN_REDIRECT", None, "HIGH"),
}


def fused(files: DataFrame, modules: list[str]) -> DataFrame:
    """Findings of several modules of FUSED in one scan and one window: repo, module, type, severity, file, line, match, detail."""
    patterns, of = [], []
    for m in modules:
        found, _, _, severity = FUSED[m]
        patterns += [(p[0], p[1], p[2] if len(p) > 2 else severity) for p in found]
        of += [m] * len(found)
    gate = F.col("content").rlike("(?d)" + catalog.STREAM_MARKER).alias("streamed")
    rows = all_matches(files.select("repo", "file", "content", gate), patterns, keep=("streamed",)).withColumn("module", F.element_at(lits(of), F.col("ordinal") + 1))
    stream = F.col("module").isin("ssrf", "redirect")
    rows = rows.where(F.when(stream, F.col("streamed")).otherwise(~F.col("text").rlike(COMMENT)))
    rows = rows.where((F.col("module") != "credentials") | ~fake_credential())
    pick = lambda k: F.element_at(lits([FUSED[m][k] or 1 << 30 for m in of]), F.col("ordinal") + 1)
    match = F.substring(F.trim("match"), F.lit(1), pick(2))
    detail = F.when(~stream, F.col("detail"))
    return first_wins(rows, ["repo", "file", "module", "line"]).select("repo", "module", pick(1).alias("type"), "severity", "file", F.col("line").cast("long").alias("line"), match.alias("match"), detail.alias("detail"))


def fake_credential() -> Column:
    """A match that holds a placeholder, or lies in a file of validators."""
    upper = F.upper("match")
    return F.exists(lits([p.upper() for p in catalog.PLACEHOLDERS]), lambda p: F.contains(upper, p)) | file_name(F.col("file")).rlike(catalog.VALIDATION_FILE)


def check_patterns(files: DataFrame, patterns: list[tuple], kind: str, comment: str = COMMENT, cut: int = 120) -> DataFrame:
    """Findings outside comment lines, the first of each line."""
    found = all_matches(files, patterns).where(~F.col("text").rlike(comment))
    if kind == "HARDCODED_CREDENTIAL":
        found = found.where(~fake_credential())
    return finding(first_wins(found, ["repo", "file", "line"]), F.lit(kind), cut)


def numbered_lines(files: DataFrame) -> DataFrame:
    return files.select("repo", "file", F.posexplode(F.split("content", "\n")).alias("pos", "text"))


def missing_auth_decorator(files: DataFrame) -> DataFrame:
    """Python routes without an auth decorator from three lines before to three after."""
    lines = F.split("content", "\n")
    around = lambda i: F.array_join(F.slice(F.col("lines"), F.greatest(i - 2, F.lit(1)), i + 4 - F.greatest(i - 3, F.lit(0))), "\n")
    py = files.where(F.col("file").endswith(".py")).withColumn("lines", lines)
    hits = F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("i"), t.alias("t"), around(i).alias("block"))), lambda x: x["t"].rlike("(?d)" + catalog.ROUTE_DECORATOR) & ~x["block"].rlike(catalog.AUTH_DECORATOR))
    return py.select("repo", "file", F.explode(hits).alias("h")).select("repo", "file", (F.col("h.i") + 1).cast("long").alias("line"), F.lit("MISSING_AUTH_DECORATOR").alias("type"), F.lit("MEDIUM").alias("severity"), F.trim("h.t").alias("match"))


def cors_misconfig(files: DataFrame) -> DataFrame:
    """Wildcard origins within 400 characters of credentials, and reflected origins."""
    java, content = "(?d)" + catalog.CORS_WILDCARD, F.col("content")
    clean = files.select("repo", "file", F.translate("content", MARK, "").alias("content"))
    wild = match_structs(content, catalog.CORS_WILDCARD, 0, "CORS_WILDCARD_WITH_CREDENTIALS", "HIGH")
    # offsets: length of what lies before each match, from the pieces between matches
    pieces, found = F.split(content, java, -1), F.regexp_extract_all(content, F.lit(java), F.lit(0))
    start = F.transform(found, lambda m, i: F.aggregate(F.transform(F.slice(pieces, 1, i + 1), lambda g: F.length(g)), F.lit(0), lambda a, n: a + n) + F.aggregate(F.transform(F.slice(found, 1, i), lambda g: F.length(g)), F.lit(0), lambda a, n: a + n))
    window = F.transform(F.arrays_zip(wild.alias("w"), start.alias("at")), lambda z: F.struct(z["w"].alias("w"), F.substr(content, F.greatest(z["at"] - 400, F.lit(0)) + 1, F.length(z["w"]["match"]) + 400 + F.least(z["at"], F.lit(400))).alias("near")))
    near = F.transform(F.filter(window, lambda z: z["near"].rlike("(?d)" + catalog.CORS_CREDENTIALS)), lambda z: z["w"])
    both = F.concat(near, match_structs(content, catalog.CORS_REFLECTION, 1, "CORS_ORIGIN_REFLECTION", "HIGH"))
    gate = clean.where(content.rlike(java) | content.rlike("(?d)" + catalog.CORS_REFLECTION))
    return finding(first_wins(gate.select("repo", "file", F.inline(both)), ["repo", "file", "line", "detail"]), F.col("detail")).drop("detail")


def origin_missing(files: DataFrame) -> DataFrame:
    """Files with an event stream and no origin check: the line of the first marker."""
    marked = F.regexp_replace(F.translate("content", MARK, ""), "(?d)" + catalog.STREAM_MARKER, MARK)
    before = F.substring_index(marked, MARK, 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    gate = F.col("content").rlike("(?d)" + catalog.STREAM_MARKER) & ~F.col("content").rlike("(?d)" + catalog.ORIGIN_VALIDATION)
    return files.where(gate).select("repo", "file", line.cast("long").alias("line"), F.lit("SSE_NO_ORIGIN_VALIDATION").alias("type"), F.lit("MEDIUM").alias("severity"), F.lit("SSE endpoint").alias("match"))


def streams(files: DataFrame) -> DataFrame:
    """Files with an event stream: the only ones in which requests and redirects of streams are looked for."""
    return files.where(F.col("content").rlike("(?d)" + catalog.STREAM_MARKER))


def stream_ssrf(files: DataFrame) -> DataFrame:
    found = all_matches(streams(files), [(p, "SSRF_STREAM", "MEDIUM") for p in catalog.STREAM_SSRF])
    return finding(first_wins(found, ["repo", "file", "line"]), F.lit("SSRF_STREAM")).drop("detail")


def redirects(files: DataFrame) -> DataFrame:
    found = all_matches(streams(files), [(p, "OPEN_REDIRECT", "HIGH") for p in catalog.REDIRECTS])
    return finding(first_wins(found, ["repo", "file", "line"]), F.lit("OPEN_REDIRECT"), None).drop("detail")


def js_tokens(files: DataFrame) -> DataFrame:
    found = all_matches(files.where(extension(F.col("file")).isin(catalog.JS_EXTENSIONS)), [("(?s)" + p, d, s) for p, d, s in catalog.JS_TOKENS]).where(~F.col("text").rlike(COMMENT_JS))
    return finding(found, F.lit("JS_DANGEROUS_CALL"), 100)


def network_bindings(files: DataFrame, snippet: bool = False) -> DataFrame:
    """Addresses that servers bind to; of several patterns on a line the first in catalogue order counts.  With snippet, ``code`` shows the line from the match to 60 characters after it."""
    first = first_wins(all_matches(files, [(p, "", "") for p, _, _ in catalog.BINDINGS]), ["repo", "file", "line"])

    def group(which: int) -> Column:
        value = F.lit(None).cast("string")
        for i, (p, *groups) in enumerate(catalog.BINDINGS):
            got = F.coalesce(*[F.nullif(F.regexp_extract("match", "(?d)" + p, g), F.lit("")) for g in groups[which]], F.lit(None).cast("string"))
            value = F.when(F.col("ordinal") == i, got).otherwise(value)
        return value

    f = first.withColumn("h", group(0)).withColumn("p", group(1).try_cast("int"))
    note = (
        F.when(F.col("h") == "0.0.0.0", "Binding to 0.0.0.0 exposes the service on ALL network interfaces")
        .when(F.col("h").isin("127.0.0.1", "localhost"), F.concat(F.lit("Binding to "), "h", F.lit(" — restricted to localhost but verify proxy/container configuration")))
        .when(F.col("h").isNotNull(), F.concat(F.lit("Explicit host binding to "), "h"))
        .otherwise("Network binding detected — verify host/interface scope")
    )
    start = F.substring_index("match", "\n", 1)
    code = F.trim(F.substr("text", F.greatest(F.instr("text", start), F.lit(1)), F.length("match") + 60))
    columns = [F.coalesce("h", F.lit("(unresolved)")).alias("host"), F.col("p").alias("port"), note.alias("note")] + [code.alias("code")] * snippet
    return f.select("repo", "file", F.col("line").cast("long").alias("line"), F.when(F.col("h") == "0.0.0.0", "HIGH").otherwise("MEDIUM").alias("severity"), *columns)


def framework_rollup(files: DataFrame) -> DataFrame:
    """One row per repository and framework: how many files hold it, and the first three of them in path order.

    Each framework's files are reduced to a count and three paths before the shuffle ends: no list of all files is built.
    """
    low = F.lower("content")
    hits = F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("framework"), F.lit(s).alias("severity"))) for i, (k, name, s) in enumerate(catalog.FRAMEWORKS)])
    each = files.select("repo", "file", F.inline(F.array_compact(hits)))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("repo", "framework").orderBy("file"))).where("n <= 3")
    few = top.groupBy("repo", "framework").agg(F.array_sort(F.collect_list("file")).alias("examples"))
    return each.groupBy("repo", "framework", "severity").agg(F.count("*").alias("n_files")).join(few, ["repo", "framework"]).select("repo", "framework", "severity", "n_files", F.col("examples")[0].alias("file"), F.concat(F.array_join("examples", ", "), F.when(F.col("n_files") > 3, F.concat(F.lit(" … (+"), (F.col("n_files") - 3).cast("string"), F.lit(" more)"))).otherwise("")).alias("examples"))


def http_indicators(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """Frameworks, one row per repository and framework, unless they are INFO and their first file has one of the bindings."""
    bound = bindings.select("repo", "file").distinct().withColumn("bound", F.lit(True))
    kept = framework_rollup(files).join(bound, ["repo", "file"], "left").where(F.col("bound").isNull() | (F.col("severity") != "INFO"))
    note = F.concat("framework", F.lit(" detected in "), F.col("n_files").cast("string"), F.lit(" file(s): "), "examples")
    return kept.select("repo", F.lit("HTTP_SERVER_INDICATOR").alias("type"), "severity", "file", F.lit(None).cast("long").alias("line"), note.alias("note"))


def network_report(files: DataFrame) -> DataFrame:
    """Bindings and HTTP indicators."""
    bindings = network_bindings(files)
    return bindings.select("repo", F.lit("NETWORK_BINDING").alias("type"), "severity", "file", "line", "note").unionByName(http_indicators(files, bindings))


def no_auth_repos(files: DataFrame) -> DataFrame:
    """Repositories with routes and no sign of authentication in any file."""
    route = F.col("content").rlike("(?di)" + "|".join(f"(?:{p})" for p in catalog.ROUTE_SIGNALS))
    return files.groupBy("repo").agg(F.bool_or(route).alias("routes"), F.bool_or(any_marker(F.col("content"), catalog.AUTH_SIGNALS)).alias("auth")).where("routes AND NOT auth").select("repo", F.lit("NO_AUTHENTICATION").alias("type"), F.lit("HIGH").alias("severity"))


def injection_hits(lines: DataFrame) -> DataFrame:
    """lines (id, line_no, text): one row per line and pattern with its first match, and one per role marker."""
    hits = [F.when(F.col("text").rlike("(?d)" + p), F.struct(F.lit(i).alias("pattern"), F.trim(F.regexp_extract("text", "(?d)" + p, 0)).alias("matched"))) for i, p in enumerate([*catalog.INJECTIONS, catalog.ROLE_MARKER])]
    return lines.select("id", "line_no", F.inline(F.array_compact(F.array(*hits))))


def sanitised(lines: DataFrame, prefix: str = "[SANITIZED: injection pattern detected] ") -> DataFrame:
    """lines with hits get a prefix and are rewritten so that they no longer read as instructions."""
    t = F.col("text")
    hit = t.rlike("(?d)" + catalog.ROLE_MARKER)
    for p in catalog.INJECTIONS:
        hit = hit | t.rlike("(?d)" + p)
    new = t
    for p, r in (
        (r"(?i)(ignore)\s+(all\s+)?(previous)", "$1 $3"),
        (r"(?i)(system)\s*:", "[$1]:"),
        (r"(?i)^\s*((?:system|user|assistant|human)\s*:)\s", "[$1]"),
        (r"(?i)<\s*/?\s*system\s*>", "[system-tag]"),
        (r"(?i)\[INST\]", "[inst-tag]"),
        (r"(?i)\[/INST\]", "[/inst-tag]"),
        (r"(?i)<\|im_start\|>", "[im-start]"),
        (r"(?i)<\|im_end\|>", "[im-end]"),
    ):
        new = F.regexp_replace(new, p, r)
    return lines.select("id", "line_no", F.when(hit, F.concat(F.lit(prefix), new)).otherwise(t).alias("text"))


def search(files: DataFrame, pattern: str, glob_regex: str | None = None, most: int = 30) -> DataFrame:
    """Lines that match, in path and line order, at most ``most``."""
    f = files.where(F.col("file").rlike(glob_regex)) if glob_regex else files
    return numbered_lines(f.where(F.col("content").rlike("(?dm)" + pattern))).where(F.col("text").rlike("(?d)" + pattern)).select("repo", "file", (F.col("pos") + 1).cast("long").alias("line"), F.trim("text").alias("text")).orderBy("repo", "file", "line").limit(most)


def keyword_lines(files: DataFrame) -> DataFrame:
    """One row per line and keyword of the first JavaScript scan, paths unfiltered."""
    js = files.where(F.col("file").endswith(".js") | F.col("file").endswith(".ts"))
    hits = F.filter(lits(catalog.JS_KEYWORDS), lambda k: F.contains(F.col("text"), k))
    lines = numbered_lines(js).withColumn("keyword", F.explode(hits))
    return lines.select("repo", "file", (F.col("pos") + 1).cast("long").alias("line"), F.trim("text").alias("text"), "keyword")
