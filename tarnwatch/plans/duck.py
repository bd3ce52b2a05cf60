"""DuckDB SQL of the views and pattern scans: the second opinion that the tests and the driver hold the queries against.

Matches get their lines here from the pieces between matches, not from marks as in the engine.
"""

from __future__ import annotations

from ..functions import catalog
from ..sources import corpus


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values: list[str], number: str) -> str:
    return f"{listed(values)}[1 + (({number}) % {len(values)})]"


NAME = "list_extract(string_split(file, '/'), -1)"
ENDING = f"lower(regexp_extract({NAME}, '[^.](\\.[^.]*)$', 1))"
SKIP = f"(list_has_any(string_split(lower(file), '/')[:-2], {listed(catalog.EXCLUDED_FOLDERS)}) OR regexp_matches({NAME}, {q(catalog.TEST_FILE)}) OR regexp_matches({NAME}, {q(catalog.EXAMPLE_FILE)}))"
SCANNABLE = f"list_contains({listed(catalog.SOURCE_EXTENSIONS)}, {ENDING}) AND NOT {SKIP} AND length(content) > 0"

CODE = f"""code_all AS (
  SELECT 'repo' || (user_id % 5) AS repo,
         {pick(corpus.FOLDERS, 'user_id')} || '/' || {pick(corpus.STEMS, 'user_id + part')} || user_id || '_' || part || {pick(corpus.ENDINGS, 'user_id + part')} AS file, content
  FROM (SELECT user_id, event_id % 9 AS part, string_agg(replace({pick(corpus.TEMPLATES, 'event_id * 13 + user_id * 5 + event_id // 37')}, '{{}}', event_id::VARCHAR), chr(10) ORDER BY event_id) AS content
        FROM events GROUP BY user_id, event_id % 9)
), code AS (SELECT * FROM code_all WHERE {SCANNABLE})"""
TEXTS = f"""texts_all AS (
  SELECT source AS repo, {pick(corpus.FOLDERS, 'doc_id')} || '/' || {pick(corpus.STEMS, 'doc_id + doc_id // 6')} || doc_id || {pick(corpus.ENDINGS, 'doc_id // 5')} AS file, text AS content FROM documents
)"""
LINES = "SELECT repo, file, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT repo, file, string_split(content, chr(10)) AS x FROM {})"


def matches(source: str, patterns: list[tuple], severity: str = "HIGH") -> str:
    """(repo, file, ordinal, idx, match, line, text, detail, severity); a pattern is (regex, detail[, severity[, re2, group]]):
    with re2 and group, that regex is used and only its matches with an empty group count (look-aheads)."""
    parts = []
    for i, (p, detail, *more) in enumerate(patterns):
        sev = more[0] if more else severity
        use, group = (more[1], more[2]) if len(more) > 1 else (p, None)
        only = f" WHERE regexp_extract(m[k], {q(use)}, {group}) = ''" if group else ""
        parts.append(f"""SELECT repo, file, {i} AS ordinal, k - 1 AS idx, m[k] AS match, content, array_to_string(g[1:k], '') || array_to_string(m[1:k-1], '') AS before, {q(detail)} AS detail, {q(sev)} AS severity
  FROM (SELECT repo, file, content, g, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT *, regexp_split_to_array(content, {q(use)}) AS g, regexp_extract_all(content, {q(use)}) AS m FROM {source})){only}""")
    union = "\nUNION ALL ".join(parts)
    return f"""SELECT *, string_split(content, chr(10))[line] AS text FROM (SELECT *, 1 + length(before) - length(replace(before, chr(10), '')) AS line FROM ({union}))"""


def first(source: str, key: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ordinal, idx) AS n FROM ({source})) WHERE n = 1"


def checked(patterns: list[tuple], kind: str) -> str:
    fake = ""
    if kind == "HARDCODED_CREDENTIAL":
        inside = " OR ".join(f"contains(upper(match), {q(p.upper())})" for p in catalog.PLACEHOLDERS)
        fake = f" AND NOT ({inside}) AND NOT regexp_matches({NAME}, {q(catalog.VALIDATION_FILE)})"
    found = f"SELECT * FROM ({matches('code', patterns)}) WHERE NOT regexp_matches(text, '^\\s*(#|//)'){fake}"
    return f"WITH {CODE} SELECT repo, file, line, {q(kind)} AS type, severity, trim(match)[:120] AS match, detail FROM ({first(found, 'repo, file, line')})"


def any_marker(text: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(m.lower())})" for m in markers) + ")"


ROUTES = f"""WITH {CODE}, l AS ({LINES.format('code')}),
w AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY repo, file ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS block FROM l)
SELECT repo, file, line, 'MISSING_AUTH_DECORATOR' AS type, 'MEDIUM' AS severity, trim(text) AS match FROM w
WHERE file LIKE '%.py' AND regexp_matches(text, {q(catalog.ROUTE_DECORATOR)}) AND NOT regexp_matches(block, {q(catalog.AUTH_DECORATOR)})"""
_cors = f"""SELECT * FROM ({matches('code', [(catalog.CORS_WILDCARD, 'CORS_WILDCARD_WITH_CREDENTIALS')])})
WHERE regexp_matches(substring(content, greatest(length(before) - 400, 0) + 1, length(match) + 400 + least(length(before), 400)), {q(catalog.CORS_CREDENTIALS)})
UNION ALL SELECT * FROM ({matches('code', [(catalog.CORS_REFLECTION, 'CORS_ORIGIN_REFLECTION')])})"""
CORS = f"WITH {CODE} SELECT repo, file, line, detail AS type, severity, trim(match)[:120] AS match FROM ({first(_cors, 'repo, file, line, detail')})"
ORIGIN = f"""WITH {CODE} SELECT repo, file, 1 + length(b) - length(replace(b, chr(10), '')) AS line, 'SSE_NO_ORIGIN_VALIDATION' AS type, 'MEDIUM' AS severity, 'SSE endpoint' AS match
FROM (SELECT *, regexp_split_to_array(content, {q(catalog.STREAM_MARKER)})[1] AS b FROM code WHERE regexp_matches(content, {q(catalog.STREAM_MARKER)}) AND NOT regexp_matches(content, {q(catalog.ORIGIN_VALIDATION)}))"""
_ssrf = [(p, "SSRF_STREAM", "MEDIUM") if "(?!" not in p else (p, "SSRF_STREAM", "MEDIUM", r"(?s)new\s+EventSource\s*\(\s*(['\"]http)?", 1) for p in catalog.STREAM_SSRF]
#: Only files with an event stream are looked at.
STREAMS = f"streams AS (SELECT * FROM code WHERE regexp_matches(content, {q(catalog.STREAM_MARKER)}))"
SSRF = f"WITH {CODE}, {STREAMS} SELECT repo, file, line, 'SSRF_STREAM' AS type, severity, trim(match)[:120] AS match FROM ({first(matches('streams', _ssrf), 'repo, file, line')})"
REDIRECTS = f"WITH {CODE}, {STREAMS} SELECT repo, file, line, 'OPEN_REDIRECT' AS type, severity, trim(match) AS match FROM ({first(matches('streams', [(p, 'OPEN_REDIRECT', 'HIGH') for p in catalog.REDIRECTS]), 'repo, file, line')})"
_tokens = []
for _p, _d, _s in catalog.JS_TOKENS:
    _tokens.append((_p, _d, _s) if "(?!" not in _p else (_p, _d, _s, "(?s)" + _p.split(r"(?!")[0] + r"(['\"`]https?://)?", 1))
JS_TOKENS = f"""WITH {CODE}, js AS (SELECT * FROM code WHERE list_contains({listed(catalog.JS_EXTENSIONS)}, {ENDING}))
SELECT repo, file, line, 'JS_DANGEROUS_CALL' AS type, severity, trim(match)[:100] AS match, detail FROM ({matches('js', _tokens)}) WHERE NOT regexp_matches(text, '^\\s*(//|\\*)')"""


def _bound(which: int) -> str:
    cases = []
    for i, (p, *groups) in enumerate(catalog.BINDINGS):
        got = [f"nullif(regexp_extract(match, {q(p)}, {g}), '')" for g in groups[which]]
        cases.append(f"WHEN {i} THEN coalesce({', '.join([*got, 'NULL'])})")
    return f"CASE ordinal {' '.join(cases)} END"


BIND_CTE = f"""bind AS (SELECT repo, file, line, CASE WHEN h = '0.0.0.0' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, coalesce(h, '(unresolved)') AS host, p AS port,
  CASE WHEN h = '0.0.0.0' THEN 'Binding to 0.0.0.0 exposes the service on ALL network interfaces' WHEN h IN ('127.0.0.1', 'localhost') THEN 'Binding to ' || h || ' — restricted to localhost but verify proxy/container configuration'
       WHEN h IS NOT NULL THEN 'Explicit host binding to ' || h ELSE 'Network binding detected — verify host/interface scope' END AS note
  FROM (SELECT *, {_bound(0)} AS h, TRY_CAST({_bound(1)} AS INTEGER) AS p FROM ({first(matches('code', [(p, '', '') for p, _, _ in catalog.BINDINGS]), 'repo, file, line')})))"""
BINDINGS = f"WITH {CODE}, {BIND_CTE} SELECT * FROM bind"
_frames = "\nUNION ALL ".join(f"SELECT repo, file, {q(name)} AS framework, {q(s)} AS severity FROM code WHERE contains(lower(content), {q(k.lower())})" for k, name, s in catalog.FRAMEWORKS)
FRAME_CTE = f"""frames AS (SELECT repo, framework, severity, count(*) AS n_files, min(file) AS file,
  array_to_string(list_sort(list(file))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' … (+' || (count(*) - 3) || ' more)' ELSE '' END AS examples FROM ({_frames}) GROUP BY repo, framework, severity)"""
FRAMEWORKS = f"WITH {CODE}, {FRAME_CTE} SELECT * FROM frames"
NETWORK = f"""WITH {CODE}, {BIND_CTE}, {FRAME_CTE}
SELECT repo, 'NETWORK_BINDING' AS type, severity, file, line, note FROM bind
UNION ALL SELECT repo, 'HTTP_SERVER_INDICATOR', severity, file, NULL, framework || ' detected in ' || n_files || ' file(s): ' || examples FROM frames f
WHERE severity <> 'INFO' OR NOT EXISTS (SELECT 1 FROM bind b WHERE b.repo = f.repo AND b.file = f.file)"""


def no_auth(repo: str) -> str:
    return f"""WITH {CODE} SELECT {repo} AS repo, 'NO_AUTHENTICATION' AS type, 'HIGH' AS severity FROM code GROUP BY {repo}
HAVING bool_or({' OR '.join(f"regexp_matches(content, {q('(?i)' + p)})" for p in catalog.ROUTE_SIGNALS)}) AND NOT bool_or({any_marker('content', catalog.AUTH_SIGNALS)})"""


#: All files of a user are one repository.
OWNER = r"([0-9]+)_[0-9]+\.[a-z]+$"
NO_AUTH_USERS = no_auth(f"regexp_extract(file, {q(OWNER)}, 1)")
CHAT = "chat AS (SELECT conv_id * 1000 + turn AS id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS text FROM (SELECT conv_id, turn, string_split(role || ': ' || text, chr(10)) AS x FROM conversations))"
INJECTIONS = f"WITH {CHAT} " + "\nUNION ALL ".join(f"SELECT id, line_no, {i} AS pattern, trim(regexp_extract(text, {q(p)}, 0)) AS matched FROM chat WHERE regexp_matches(text, {q(p)})" for i, p in enumerate([*catalog.INJECTIONS, catalog.ROLE_MARKER]))
_new = "text"
for _p, _r in ((r"(?i)(ignore)\s+(all\s+)?(previous)", r"\1 \3"), (r"(?i)(system)\s*:", r"[\1]:"), (r"(?i)^\s*((?:system|user|assistant|human)\s*:)\s", r"[\1]"), (r"(?i)<\s*/?\s*system\s*>", "[system-tag]"), (r"(?i)\[INST\]", "[inst-tag]"), (r"(?i)\[/INST\]", "[/inst-tag]"), (r"(?i)<\|im_start\|>", "[im-start]"), (r"(?i)<\|im_end\|>", "[im-end]")):
    _new = f"regexp_replace({_new}, {q(_p)}, {q(_r)}, 'g')"
SANITISED = f"WITH {CHAT} SELECT id, line_no, CASE WHEN {' OR '.join(f'regexp_matches(text, {q(p)})' for p in [*catalog.INJECTIONS, catalog.ROLE_MARKER])} THEN '[SANITIZED: injection pattern detected] ' || {_new} ELSE text END AS text FROM chat"
SEARCH = f"WITH {CODE} SELECT repo, file, line, trim(text) AS text FROM ({LINES.format('code')}) WHERE regexp_matches(file, '\\.py$') AND regexp_matches(text, 'auth|token') ORDER BY repo, file, line LIMIT 30"
KEYWORDS = f"WITH {CODE} " + "\nUNION ALL ".join(f"SELECT repo, file, line, trim(text) AS text, {q(k)} AS keyword FROM ({LINES.format('code_all')}) WHERE (file LIKE '%.js' OR file LIKE '%.ts') AND contains(text, {q(k)})" for k in catalog.JS_KEYWORDS)
