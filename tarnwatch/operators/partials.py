"""Partial results per file that merge to answers per repository, so that new files cost a scan of themselves only.

A partial is one small row per file: flags, counts, and what a rollup needs of it.  All merges are sums, ors and smallest paths, so partials of any batches may be put together in any order; of a file that comes again, the row
with the highest ``seq`` counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import any_marker, extension


def file_partials(files: DataFrame, seq: int = 0) -> DataFrame:
    """files (repo, file, content) as (repo, file, seq, py, js, routes, auth, frameworks)."""
    low, ending = F.lower("content"), extension(F.col("file"))
    route = F.col("content").rlike("(?di)" + "|".join(f"(?:{p})" for p in catalog.ROUTE_SIGNALS))
    frameworks = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(name)) for k, name, _ in catalog.FRAMEWORKS]))
    return files.select("repo", "file", F.lit(seq).cast("long").alias("seq"), (ending == ".py").cast("int").alias("py"), ending.isin(catalog.JS_EXTENSIONS).cast("int").alias("js"), route.alias("routes"), any_marker(F.col("content"), catalog.AUTH_SIGNALS).alias("auth"), frameworks.alias("frameworks"))


def latest(partials: DataFrame) -> DataFrame:
    """The last partial of each file."""
    rest = [c for c in partials.columns if c not in ("repo", "file")]
    return partials.groupBy("repo", "file").agg(F.max_by(F.struct(*rest), "seq").alias("p")).select("repo", "file", "p.*")


def first_paths(df: DataFrame, keys: list[str], out: str, n: int = 3) -> DataFrame:
    """(keys, out): the first n paths; ranks beyond n are dropped before the shuffle, so no list of all files is built."""
    top = df.select(*keys, "file").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file"))).where(F.col("_n") <= n)
    return top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias(out))


def repo_answers(partials: DataFrame) -> DataFrame:
    """(repo, n_files, py, js, no_auth, first_files): how many files of each language, whether there are routes and no sign of authentication, the first three paths."""
    own = latest(partials)
    flags = own.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("py").alias("py"), F.sum("js").alias("js"), (F.bool_or("routes") & ~F.bool_or("auth")).alias("no_auth"))
    return flags.join(first_paths(own, ["repo"], "first_files"), "repo")


def framework_counts(partials: DataFrame) -> DataFrame:
    """(repo, framework, n_files, examples): the first three paths of each."""
    keys = ["repo", "framework"]
    each = latest(partials).select("repo", "file", F.explode("frameworks").alias("framework"))
    return each.groupBy(*keys).agg(F.count("*").alias("n_files")).join(first_paths(each, keys, "examples"), keys)
