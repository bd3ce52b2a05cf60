"""Personal data by weak supervision.

Base spans of four kinds (email, ip, card, phone) are found by fixed rules and always stay.  On top, wide generators propose candidates of three more kinds:
``secret`` (long tokens with letters and digits), ``number`` (9 to 19 digits or an account number of letters and digits, that are no base span) and ``name`` (two or
three capitalised words in a row, or one after a title or a cue such as "name:").  Most candidates are wrong: hashes, order numbers, places, headings.
Five labelers look at different things of a candidate: a regex on its shape, a checksum (Luhn, mod 97, entropy of the characters), gazetteers (given names,
prefixes of keys, units, words that no name holds), the words before it, and the syntax around it (assignments, quotes, prose, verbs); each says yes, no or nothing.
Expectation-maximisation over the votes of the whole corpus estimates, for each kind, how reliable each labeler is and, with that, how likely each
vote pattern is right; a logistic span classifier per kind, over more features than any labeler sees, is trained on those and adds the candidates that it accepts.

One pass over the whole texts writes the spans with their feature bits; what is gathered for training is a count per (kind, bits), at most
3 * 2**14 rows whatever the input.

Defined results: null text counts as empty, without spans; very long texts are scanned whole, in time linear in their length; spans of added kinds touch no base span and not each
other (account numbers first, then secrets, numbers and names, each from left to right); rows with null doc_id and repeated rows are scanned like any other; a tie of the classifier
(log odds of 0) is a no; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number", "name")
KINDS = BASE_KINDS + ADDED_KINDS
SECRET, NUMBER, NAME = 4, 5, 6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits, so the look-behind only spares the retries inside long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Generators of candidates
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGITS = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){8,18}(?![0-9A-Za-z])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
_WORD = r"[A-ZÀ-Þ][a-zà-ÿ]+(?:['’-][A-ZÀ-Þ][a-zà-ÿ]+)?"
NAMES = re.compile(rf"(?<!\w){_WORD}(?: {_WORD}){{1,2}}(?!\w)")
CUED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? |[Nn]ame(?: is|:) |Dear |[Cc]ontact |[Ss]igned,? |[Rr]egards,\s)({_WORD}(?: {_WORD}){{0,2}})(?!\w)")

# Gazetteers
GIVEN = frozenset("James Mary John Linda Robert Susan Michael Sarah David Karen Thomas Anna Peter Maria Hans Julia Jean Claire Pierre Sophie Carlos Lucía José Carmen Juan Ana Emma Olivia Liam Noah Paul Laura Daniel Sofia Lukas Lena Louis Camille Hugo Elena Pablo Marta Jan Eva Ivan Olga Ali Fatima Wei Mei Raj Priya".split())
NO_NAME = frozenset("Street Road Avenue University College Inc Ltd Corp Company Foundation License Licence Software Version Chapter Section Figure Table Part Page North South East West New United States Kingdom City County River Lake Bank Institute Department Ministry January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
STARTERS = frozenset("The This That These Those A An In On At For Of And But Or If When While With From To As By It He She We They You I Is Are Was Der Die Das Und Ein Eine Im Le La Les Un Une Des El Los Las Y En De".split())
KEY_PREFIX = re.compile(r"(?:sk|pk|rk)[-_]|gh[pousr]_|AKIA|ASIA|eyJ|xox[abprs]-|glpat-")
UNIT = re.compile(r"\s?(?:%|ms\b|s\b|kg\b|km\b|bytes\b|px\b|USD\b|EUR\b|€|\$|times\b|people\b|years\b)")

# Words before a candidate that speak for it or against it
FOR = {
    SECRET: re.compile(r"token|secret|passw|pwd|api.?key|auth|credential|private|bearer|access.?key", re.IGNORECASE),
    NUMBER: re.compile(r"ssn|social|iban|account|passport|tax|insur|card|phone|tel\b|call|fax|konto|compte|cuenta|licen[cs]e|member", re.IGNORECASE),
    NAME: re.compile(r"(?:name(?: is|:)|dear|contact|regards,?|sincerely,?|signed,?|patient|customer|employee|author|from:|to:|attn\.?:?|by)\s*$", re.IGNORECASE),
}
AGAINST = {
    SECRET: re.compile(r"commit|sha-?\d*|md5|hash|digest|etag|uuid|guid|revision|checksum|build|version|https?:|file|path", re.IGNORECASE),
    NUMBER: re.compile(r"order|invoice|isbn|issn|figure|version|page|serial|build|timestamp|sku|part|item|total|sum|about|over|row", re.IGNORECASE),
    NAME: re.compile(r"\b(?:in|at|near|of|the|to|der|die|das|la|le|les|el|los)\s$"),
}
VERB = re.compile(r"(?:'s\b|,? (?:said|says|wrote|asked|told|lives|called|phoned|born|works|replied|sagte|schrieb|dit|dijo)\b| <| \()")

#: Feature bits of each kind, lowest first.
BITS = {
    SECRET: ("hex", "long", "mixed", "prefix", "uuid", "entropy_high", "entropy_low", "quoted", "assigned", "for", "against", "in_prose", "path", "many_digits"),
    NUMBER: ("grouped", "ssn", "account", "checked", "card_length", "for", "against", "assigned", "in_prose", "unit_after", "repeated"),
    NAME: ("title", "given", "three", "sentence_start", "for", "verb_after", "near_base", "against", "starter", "no_name", "title_line", "one"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the added kinds that touch no base span and not each other."""
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[int, int, int]] = []

    def add(kind: int, start: int, end: int) -> None:
        at = bisect.bisect_left(taken, (end, 0))  # the spans before at begin before end
        if at == 0 or max(e for _, e in taken[max(0, at - len(KINDS)) : at]) <= start:
            taken.insert(at, (start, end))
            out.append((kind, start, end))

    if DIGIT.search(text):
        for m in ACCOUNT.finditer(text):
            add(NUMBER, m.start(), m.end())
        for m in TOKEN.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                add(SECRET, m.start(), m.end())
        for m in DIGITS.finditer(text):
            add(NUMBER, m.start(), m.end())
    for m in CUED.finditer(text):
        add(NAME, m.start(1), m.end(1))
    for m in NAMES.finditer(text):
        words = m[0].split(" ")
        if len(set(words)) == len(words):  # no name repeats a word
            add(NAME, m.start(), m.end())
    return sorted(out)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def account_checks(s: str) -> bool:
    """Mod 97 of an account number of letters and digits."""
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: int, start: int, end: int, base: list[tuple[int, int, int]]) -> int:
    """Feature bits of a candidate; 0 for base spans, which nothing decides about."""
    if kind < SECRET:
        return 0
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    last = before.rsplit("\n", 1)[-1]
    in_prose = before[-2:-1].isalpha() and before[-1:] == " " and after[:1] == " " and after[1:2].isalpha()
    speaks_for, against = bool(FOR[kind].search(before)), bool(AGAINST[kind].search(before if kind == NAME else last))
    digits = sum("0" <= c <= "9" for c in s)
    assigned = bool(re.search(r"[:=#]\s*[\"'`]?$", before))
    if kind == SECRET:
        h = entropy(s)
        flags = (
            bool(re.fullmatch(r"[0-9A-Fa-f]+", s)), len(s) >= 32, any(c.islower() for c in s) and any(c.isupper() for c in s), bool(KEY_PREFIX.match(s)), bool(re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", s)),
            h >= 3.3, h < 2.8, before[-1:] in "\"'`" and bool(before) and after[:1] in "\"'`" and bool(after), assigned, speaks_for, against, in_prose, s.count("/") > 1 or s.count("-") > 3, digits * 4 >= len(s),
        )
    elif kind == NUMBER:
        plain = re.sub(r"[ .-]", "", s)
        account = not plain.isdigit()
        flags = (
            plain != s, bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s)), account, account_checks(s) if account else 13 <= digits <= 19 and luhn(plain), not account and 13 <= digits <= 19,
            speaks_for, against, assigned or bool(re.search(r"(?:no|nr|n°)\.?\s$", before, re.IGNORECASE)), in_prose, bool(UNIT.match(after)), len(set(plain)) <= 2,
        )
    else:
        words, line = s.split(" "), text[text.rfind("\n", max(0, start - 120), start) + 1 or max(0, start - 120) : start]
        rest = text[end : end + 120].split("\n", 1)[0]
        around = [w for w in (line + s + rest).split(" ") if w]
        flags = (
            bool(re.search(rf"\b(?:{'|'.join(TITLES)})\.? $", before)) or words[0] in TITLES, words[0] in GIVEN, len(words) >= 3, not before.strip(" ") or before.rstrip(" ")[-1:] in ".!?\n|>*#", speaks_for, bool(VERB.match(after)),
            any(abs(b - end) <= 60 or abs(start - e) <= 60 for _, b, e in near(base, start)), against, words[0] in STARTERS, any(w in NO_NAME for w in words), len(around) > 2 and sum(w[:1].isupper() for w in around) * 4 >= len(around) * 3, len(words) == 1,
        )
    return sum(1 << i for i, f in enumerate(flags) if f)


def near(base: list[tuple[int, int, int]], start: int) -> list[tuple[int, int, int]]:
    """The spans of base next to a place; base is in order of start within each kind."""
    out, at = [], 0
    for kind in range(len(BASE_KINDS)):
        end = bisect.bisect_left(base, (kind + 1,), at)
        k = bisect.bisect_left(base, (kind, start, 0), at, end)
        out += base[max(at, k - 1) : min(end, k + 1)]
        at = end
    return out


LABELERS = ("regex", "checksum", "gazetteer", "context", "syntax")


def votes(kind: int, bits: int) -> list[int]:
    """Of the labelers in order: 1 yes, -1 no, 0 nothing."""
    on = {b: bool(bits >> i & 1) for i, b in enumerate(BITS[kind])}
    say = lambda yes, no: int(yes) if yes else -int(no)
    if kind == SECRET:
        return [
            say((on["hex"] and on["long"]) or (on["mixed"] and on["many_digits"]), on["uuid"] or on["path"]), say(on["entropy_high"], on["entropy_low"]), say(on["prefix"], False),
            say(on["for"] and not on["against"], on["against"] and not on["for"]), say(on["quoted"] or on["assigned"], on["in_prose"]),
        ]
    if kind == NUMBER:
        return [say(on["ssn"] or on["account"], on["repeated"]), say(on["checked"], on["card_length"] or on["account"]), say(False, on["unit_after"]), say(on["for"] and not on["against"], on["against"] and not on["for"]), say(on["assigned"], on["in_prose"])]
    return [say(False, on["sentence_start"]), 0, say(on["given"], on["starter"] or on["no_name"]), say(on["title"] or on["for"] or on["near_base"], on["against"]), say(on["verb_after"], on["title_line"])]


@dataclass
class SpanModel:
    """Weights (bias first) of each added kind, and how often each labeler says yes for right and for wrong candidates."""

    weights: dict[int, np.ndarray] = field(default_factory=dict)
    reliability: dict = field(default_factory=dict)

    @staticmethod
    def row(kind: int, bits: int) -> np.ndarray:
        return np.array([1] + [bits >> i & 1 for i in range(len(BITS[kind]))], dtype=float)

    def accepts(self, kind: int, bits: int) -> bool:
        return kind in self.weights and float(self.row(kind, bits) @ self.weights[kind]) > 0


def posterior(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns v (rows) that n candidates have: how likely each is right, and rates[right, labeler, vote + 1]."""
    p = 1 / (1 + np.exp(-(1.5 * v.sum(axis=1) - 0.75)))  # start: majority, and silence is a no
    rate = np.zeros((2, v.shape[1], 3))
    for _ in range(rounds):
        for y, w in enumerate((n * (1 - p), n * p)):
            for j in range(v.shape[1]):
                # a few prior votes: labelers are right more often than wrong
                seen = np.array([(w * (v[:, j] == x)).sum() for x in (-1, 0, 1)]) + np.array([[4, 2, 1], [1, 2, 4]][y])
                rate[y, j] = seen / seen.sum()
        for j in range(v.shape[1]):  # a yes never speaks against a candidate, nor a no for it: else the two classes may change places
            for x, right in ((0, 0), (2, 1)):
                if rate[right, j, x] < rate[1 - right, j, x]:
                    rate[:, j, x] = rate[:, j, x].mean()
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        log = np.log(prior / (1 - prior)) + sum(np.log(rate[1, j][v[:, j] + 1] / rate[0, j][v[:, j] + 1]) for j in range(v.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p, rate


def fit_spans(counts: list[tuple[int, int, int]], steps: int = 600) -> SpanModel:
    """counts: (kind, bits, n).  For each added kind EM over the labelers' votes, then logistic regression on its posteriors."""
    model = SpanModel()
    for kind in (SECRET, NUMBER, NAME):
        mine = [(b, n) for k, b, n in counts if k == kind]
        if not mine:
            continue
        v, n = np.array([votes(kind, b) for b, _ in mine]), np.array([c for _, c in mine], dtype=float)
        p, rate = posterior(v, n)
        x = np.array([SpanModel.row(kind, b) for b, _ in mine])
        w, weight = np.zeros(x.shape[1]), np.log1p(n) / np.log1p(n).sum()
        for _ in range(steps):
            w -= 2.0 * (x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p)) + 1e-4 * w)
        model.weights[kind] = w
        model.reliability[KINDS[kind]] = {a: {"yes_if_right": float(rate[1, j, 2]), "yes_if_wrong": float(rate[0, j, 2])} for j, a in enumerate(LABELERS)}
    return model


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def propose(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id and the arrays kind, start, stop, bits of all spans, base ones and candidates."""

    @F.pandas_udf("kind array<int>, start array<int>, stop array<int>, bits array<int>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base = base_spans(t or "")
            both = base + candidates(t or "", base)
            rows.append(([k for k, _, _ in both], [s for _, s, _ in both], [e for _, _, e in both], [features(t, *x, base) for x in both]))
        return pd.DataFrame(rows, columns=["kind", "start", "stop", "bits"])

    return docs.select("doc_id", scan(F.coalesce("text", F.lit(""))).alias("found")).select("doc_id", "found.*")


def train_spans(proposed: DataFrame) -> SpanModel:
    """Fits on the candidates of all documents."""
    each = proposed.select(F.explode(F.arrays_zip("kind", "bits")).alias("s")).where(F.col("s.kind") >= SECRET).groupBy("s.kind", "s.bits").agg(F.count("*").alias("n"))
    return fit_spans(sorted((r["kind"], r["bits"], r["n"]) for r in each.collect()))  # 3 * 2**14 rows at most


def accept(proposed: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, the counts n_<kind> of all kinds, base (string) and spans (string)."""
    counts = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{c} long" for c in counts) + ", base string, spans string")
    def join(kind: pd.Series, start: pd.Series, stop: pd.Series, bits: pd.Series) -> pd.DataFrame:
        rows = []
        for k, s, e, b in zip(kind, start, stop, bits, strict=True):
            every = [tuple(map(int, x)) for x in zip(k, s, e, b, strict=True)]
            base = [x[:3] for x in every if x[0] < SECRET]
            both = base + [x[:3] for x in every if x[0] >= SECRET and model.accepts(x[0], x[3])]
            n = Counter(x[0] for x in both)
            rows.append((*(n[i] for i in range(len(KINDS))), spans_text(base), spans_text(both)))
        return pd.DataFrame(rows, columns=[*counts, "base", "spans"])

    return proposed.select("doc_id", join("kind", "start", "stop", "bits").alias("r")).select("doc_id", "r.*")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_<kind> of all seven kinds, base, spans."""
    proposed = write_table(propose(docs), "op8-spans")
    return accept(proposed, train_spans(proposed))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    added = [f"n_{k}" for k in ADDED_KINDS]
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", *added, total)


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express: what the base rules find."""
    return op8_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256")


def _spans_sql(kind: int, pattern: str, keep: str) -> str:
    return f"""SELECT r, {kind} AS kind, s, s + length(v) AS e FROM (SELECT r, m[k] AS v, length(array_to_string(g[1:k], '')) + length(array_to_string(m[1:k-1], '')) AS s
  FROM (SELECT r, g, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT r, regexp_split_to_array(x, '{pattern}') AS g, regexp_extract_all(x, '{pattern}') AS m FROM t))) WHERE {keep}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT WHEN reverse({_DIGITS})[i]::INT > 4 THEN reverse({_DIGITS})[i]::INT * 2 - 9 ELSE reverse({_DIGITS})[i]::INT * 2 END)) % 10 = 0"
BASE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
s AS ({_spans_sql(0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
UNION ALL {_spans_sql(1, r'[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_full_match(p, '0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 0")}
UNION ALL {_spans_sql(2, r'[0-9](?:[ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")}
UNION ALL {_spans_sql(3, r'[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 9 AND 15")}),
a AS (SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(BASE_KINDS))}, string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN a ON a.r = t.r"""
