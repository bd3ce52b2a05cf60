"""Incremental scans: only files that are new since the last run, exactly once, through a file-source stream and its checkpoint.

The engine has no windowed semantics of its own; each micro-batch runs the same batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.partials import file_partials
from ..sources.corpus import CORPUS_SCHEMA, scannable


def stream_corpus(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of (repo, file, content) that arrive below path."""
    return spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def scan_new(corpus: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends scan's findings of all files that have arrived to out, then ends; a second call only reads what came meanwhile.

    A batch writes into a folder of its own number, so a batch that is repeated after a failure replaces its rows instead of doubling them.
    """

    def one(batch: DataFrame, number: int) -> None:
        scan(scannable(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return corpus.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_partials(corpus: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Partial results of all files that have arrived, one folder per batch; ``partials_of`` reads them.  A file that comes again counts as it came last."""

    def one(batch: DataFrame, number: int) -> None:
        file_partials(scannable(batch), number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return corpus.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partials_of(spark: SparkSession, out: str) -> DataFrame:
    """What ``keep_partials`` has stored, for ``partials.repo_answers`` and ``partials.framework_counts``: questions to repositories cost a read of small rows, not of files."""
    return spark.read.parquet(out).drop("batch")
