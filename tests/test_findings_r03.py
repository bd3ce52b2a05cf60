"""Findings of round 3: parsed sinks are found in one parse that is dealt out; merged findings keep the numbers of discoveries."""

from pyspark.sql import functions as F

from tarnwatch.functions import catalog
from tarnwatch.operators import review, structure
from tarnwatch.plans import parsers, relational
from tarnwatch.plans.graphs import sink_catalogue
from tarnwatch.plans.programs import programs

SF = "/root/testdata/sf0.001"


def test_programs_are_parsed_in_several_tasks(spark):
    dealt = programs(spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) <= sum(r["count"] for r in dealt) / 2


def test_parsed_sinks_parse_once(spark):
    plan = parsers.QUERIES["parsed_sinks"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_sinks_of_calls_that_are_alike(spark):
    """A call that two entries of a type fit is one sink, and so are calls that are alike; SQL calls stay as they are."""
    call = "repo string, file string, func string, func_line int, callee string, dotted string, line int, influenced array<string>, shell boolean, dynamic boolean"
    rows = [
        ("r", "a.js", "f", 1, "exec", "child_process.exec", 2, ["a"], False, True), ("r", "a.js", "f", 1, "exec", "child_process.exec", 2, ["a"], False, True), ("r", "a.js", "f", 1, "get", "axios.get", 3, [], False, True),
        ("r", "a.js", "f", 1, "query", "db.query", 4, ["a"], False, False), ("r", "a.js", "f", 1, "query", "db.query", 4, ["a"], False, False), ("r", "a.js", "f", 1, "new Function", "new Function", 5, ["a"], False, False),
        ("r", "b.py", "g", 1, "run", "subprocess.run", 2, [], True, False), ("r", "b.py", "g", 1, "execute", "c.execute", 3, [], False, True), ("r", "b.py", "g", 1, "execute", "c.execute", 4, [], False, False), ("r", "b.py", "g", 1, None, None, 5, ["a"], True, True),
    ]
    found = structure.sinks_of(spark.createDataFrame(rows, call), sink_catalogue(spark), sink_catalogue(spark, catalog.SINKS_JS))
    assert found.columns == ["repo", "file", "func", "func_line", "sink_type", "sink_expr", "severity", "line", "influenced", "note"]
    assert sorted((r["sink_type"], r["sink_expr"], r["severity"], r["line"], r["note"]) for r in found.collect()) == [
        ("COMMAND", "child_process.exec", "HIGH", 2, "template literal injection — CRITICAL"), ("COMMAND", "subprocess.run", "HIGH", 2, "shell=True — CRITICAL"), ("EXEC", "new Function", "HIGH", 5, "dynamic code construction"),
        ("SQL", "c.execute", "HIGH", 3, "dynamic SQL construction"), ("SQL", "db.query", "HIGH", 4, ""), ("SQL", "db.query", "HIGH", 4, ""),
    ]


def test_merged_findings_number_discoveries(spark):
    run, sql = relational.QUERIES["merged_findings"]
    new = run(spark, SF).where("verdict = 'discovered'").select("id", "title").collect()
    items = {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {(r["id"], r["title"]) for r in new} == {(1_000_000 + i, f"New {i}") for i in items} and len(new) == len(items)
    assert "CASE WHEN verdict <> 'discovered'" not in sql


def test_merge_without_numbers(spark):
    findings = spark.createDataFrame([("r", 1, "LOW", "t", "f", 2)], "repo string, id long, severity string, title string, file string, line long")
    verdicts = spark.createDataFrame([], "repo string, id long, verdict string, new_severity string, evidence string, seq int")
    new = findings.withColumn("title", F.lit("n"))
    ids = lambda new: sorted((r["title"], r["id"]) for r in review.merge_verdicts(findings, verdicts, new).collect())
    assert ids(new.drop("id")) == [("n", None), ("t", 1)] and ids(new.withColumn("id", F.lit(7).cast("long"))) == [("n", 7), ("t", 1)]
