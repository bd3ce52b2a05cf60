"""Running many assessments: timeouts, a bounded pool with cancellation, and an agent's session with its budgets."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any

from pyspark import inheritable_thread_target
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..api import MODULES, Corpus


def within(spark: SparkSession, seconds: float, work: Callable[[], Any], otherwise: Any = None) -> tuple[Any, bool]:
    """(result of work, False), or (otherwise, True) if it takes longer: its Spark jobs, which carry a tag of their own, are then cancelled.  0 seconds: no limit."""
    if seconds <= 0:
        return work(), False
    tag, box = f"within-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            box["result"] = work()
        except Exception as e:  # noqa: BLE001  handed on below
            box["error"] = e
        finally:
            spark.removeTag(tag)

    thread = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        return otherwise, True
    if "error" in box:
        raise box["error"]
    return box["result"], False


def run_all(spark: SparkSession, tasks: dict[str, Callable[[], Any]], workers: int = 1, seen: Callable[[str, int, int], None] | None = None) -> dict[str, tuple[Any, str | None]]:
    """Results by name as (result, None) or (None, error); ``workers`` at a time.  seen(name, done, all) follows each.  An interrupt cancels what runs and what waits."""
    out: dict[str, tuple[Any, str | None]] = {}
    tag = f"run-{uuid.uuid4().hex}"

    def one(work: Callable[[], Any]) -> Any:
        spark.addTag(tag)
        try:
            return work()
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        waiting = {pool.submit(inheritable_thread_target(spark)(one), work): name for name, work in tasks.items()}
        try:
            for future in as_completed(waiting):
                name = waiting[future]
                try:
                    out[name] = (future.result(), None)
                except Exception as e:  # noqa: BLE001  a failed assessment is a row of the summary
                    out[name] = (None, str(e))
                if seen:
                    seen(name, len(out), len(tasks))
        except KeyboardInterrupt:
            pool.shutdown(wait=False, cancel_futures=True)
            spark.interruptTag(tag)
            raise
    return out


def invalid(spark: SparkSession, pattern: str) -> str:
    """What is wrong with a regular expression, before a job runs into it; empty if nothing is."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (PySparkException, Py4JJavaError) as e:
        return str(e).strip().split("\n", 1)[0]
    return ""


class Session:
    """An agent's questions to a corpus: list, search, read, run and report, each counted; reads of a path and in all have a budget, and so has the number of turns."""

    TOOLS = ("list_files", "search_code", "read_file", "run_analyzer", "report_findings")

    def __init__(self, corpus: Corpus, turns: int = 15, reads_per_path: int = 2, reads: int = 30) -> None:
        self.corpus, self.turns, self.per_path, self.all_reads = corpus, turns, reads_per_path, reads
        self.calls, self.reads, self.findings, self.summary = Counter(), Counter(), [], ""
        self.done = self.cut_short = False

    def call(self, tool: str, **given: Any) -> DataFrame | str:
        """What a tool returns: a DataFrame, or a sentence where the budget or the tool says no."""
        if tool not in self.TOOLS:
            return f"unknown tool {tool}"
        self.calls[tool] += 1
        if tool == "list_files":
            return self.corpus.list(given.get("prefix", ""))
        if tool == "search_code":
            pattern = given.get("pattern", "")
            wrong = invalid(self.corpus.files.sparkSession, pattern)
            return f"invalid pattern {pattern}: {wrong}" if wrong else self.corpus.search(pattern, given.get("glob"))
        if tool == "run_analyzer":
            name = given.get("name", "")
            return self.corpus.run(name) if name in MODULES else f"unknown analyzer {name}; known are {', '.join(sorted(MODULES))}"
        if tool == "read_file":
            path = given.get("path", "")
            if path.startswith(("/", "~")) or ".." in path.replace("\\", "/").split("/"):
                return f"{path} lies outside the repository"
            if self.reads[path] >= self.per_path:
                return f"{path} was read {self.per_path} times already"
            if self.reads.total() >= self.all_reads:
                return f"{self.all_reads} reads are used up"
            self.reads[path] += 1
            return self.corpus.read(path, given.get("start", 1), given.get("end", 400))
        self.findings, self.summary, self.done = list(given.get("findings", [])), given.get("summary", ""), True
        return "reported"

    def run(self, next_calls: Callable[[list[tuple[str, Any]]], Iterable[tuple[str, dict]]]) -> Session:
        """Asks next_calls(answers so far) for the calls of each turn until findings are reported, no call comes, or the turns are used up."""
        answers: list[tuple[str, Any]] = []
        for _ in range(self.turns):
            calls = list(next_calls(answers))
            if not calls:
                return self
            answers = [(tool, self.call(tool, **given)) for tool, given in calls]
            if self.done:
                return self
        self.cut_short = True
        return self
