"""Tables that are replaced as a whole: versioned folders and numbered pointers, for progress lists, function indexes and partial results.

A new version is written beside the old ones first.  It counts from the moment in which the next pointer file, ``_at-<number>``, is created and holds the version's name; creating it fails if another writer took that number, and
then ``update`` starts again from that writer's version, so no update is lost.  A crash at any step leaves the version before: a folder without a pointer, or a pointer without content, is never read.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(OSError):
    """Another writer has moved the table meanwhile."""


class Versioned:
    """A table below ``path`` with one schema; ``keep`` older versions stay for readers that have begun."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2) -> None:
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"_at-(\d+)", n)))

    def _target(self, number: int) -> str | None:
        """The version that a pointer names; none while its content isn't whole."""
        stream = self._fs.open(self._path(f"{self.path}/_at-{number}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.strip() if text.endswith("\n") else None

    def current(self) -> tuple[int, str | None]:
        """(number of the last pointer, version of the last whole one)."""
        numbers = self._pointers()
        target = next((t for n in reversed(numbers) if (t := self._target(n))), None)
        return (numbers[-1] if numbers else 0), target

    def read(self) -> DataFrame:
        """The current version; an empty table before the first."""
        _, version = self.current()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def stage(self, df: DataFrame) -> str:
        """Writes df as a version that doesn't count yet."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        return version

    def publish(self, version: str, after: int) -> None:
        """Makes a version the current one, if the last pointer still is ``after``."""
        pointer = self._path(f"{self.path}/_at-{after + 1}")
        if self._fs.exists(pointer):
            raise Conflict(f"{self.path} was moved past {after}")
        try:
            stream = self._fs.create(pointer, False)
        except Exception as e:
            if self._fs.exists(pointer):
                raise Conflict(f"{self.path} was moved past {after}") from e
            raise
        stream.write(bytearray(f"{version}\n".encode()))
        stream.close()

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> DataFrame:
        """Replaces the table by change(table); starts again where another writer was first."""
        for n in range(tries):
            number, version = self.current()
            staged = self.stage(change(self.read()))
            try:
                self.publish(staged, number)
            except Conflict:
                self._fs.delete(self._path(f"{self.path}/{staged}"), True)
                time.sleep(0.05 * n)
                continue
            self._sweep()
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{staged}")
        raise Conflict(f"{self.path}: {tries} tries")

    def _sweep(self) -> None:
        """Deletes versions that pointers older than the last ``keep`` + 1 name, then those pointers."""
        for number in self._pointers()[: -(self.keep + 1)]:
            if old := self._target(number):
                self._fs.delete(self._path(f"{self.path}/{old}"), True)
            self._fs.delete(self._path(f"{self.path}/_at-{number}"), False)
