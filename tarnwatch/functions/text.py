"""Scalar expressions: paths, severities, matches with their lines, token and cost estimates.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog

MARK = "\u0001"


def lits(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Last dot of the file name and what follows, lower case; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1))


def is_test_file(name: Column) -> Column:
    return name.rlike(catalog.TEST_FILE) | name.rlike(catalog.EXAMPLE_FILE)


def skip_path(path: Column) -> Column:
    """A folder of the path, relative to its repository, is excluded, or the file is a test or an example."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, lits(catalog.EXCLUDED_FOLDERS)) | is_test_file(file_name(path))


def severity_rank(severity: Column) -> Column:
    """0 for the worst severity; 9 for an unknown one or null."""
    rank = F.lit(9)
    for i, s in reversed(list(enumerate(catalog.SEVERITIES))):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def any_marker(text: Column, markers: list[str]) -> Column:
    """The text holds one of the markers, whatever their case."""
    low = F.lower(text)
    return F.exists(lits([m.lower() for m in markers]), lambda m: F.contains(low, m))


def match_structs(content: Column, pattern: str, ordinal: int, detail: str, severity: str) -> Column:
    """All matches of a literal pattern: array of (ordinal, idx, match, line, text of that line, detail, severity).

    A mark is put before every match, and the marks per line give the lines of the matches in order: linear in the content, and the
    pattern is compiled once.  Content must hold no mark of its own.
    """
    java = "(?d)" + pattern
    lines = F.split(F.regexp_replace(content, java, MARK + "$0"), "\n")
    starts = F.flatten(F.transform(lines, lambda t, i: F.array_repeat(F.struct((i + 1).alias("line"), F.replace(t, F.lit(MARK), F.lit("")).alias("text")), (F.length(t) - F.length(F.replace(t, F.lit(MARK), F.lit("")))))))
    zipped = F.arrays_zip(F.regexp_extract_all(content, F.lit(java), F.lit(0)).alias("m"), starts.alias("s"))
    return F.transform(
        zipped,
        lambda z, i: F.struct(F.lit(ordinal).alias("ordinal"), i.alias("idx"), z["m"].alias("match"), z["s"]["line"].alias("line"), z["s"]["text"].alias("text"), F.lit(detail).alias("detail"), F.lit(severity).alias("severity")),
    )


def estimate_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / F.lit(3.5))).cast("long")


def head_and_tail(text: Column, most: int, marker: str = "\n... [truncated] ...\n", share: float = 0.7) -> Column:
    """Longer text keeps its first 70 % and last 30 % of ``most`` characters around a marker."""
    head = int(most * share)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(most - head))))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
