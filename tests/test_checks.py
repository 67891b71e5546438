"""Rules of a table from one scan, and counts made while rows are written."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import quality as H

ROWS = [(1, "a/b", "c", 5, 1), (2, "a", "b/c", 9, 1), (2, "x", "y", None, 2), (3, "x", "y", 1, 3), (None, "x", None, 7, None), (None, None, None, 8, 3)]


def checks(rows, parents):
    return H.check_table(
        rows,
        unique={"id": ["id"], "pair": ["a", "b"]},
        domains={"score": (["id", "a"], F.col("score") < 6)},
        references={"parent": (["parent"], parents), "again": (["id"], parents)},
    )


def test_rules_of_one_table(spark):
    rows = spark.createDataFrame(ROWS, "id int, a string, b string, score int, parent int")
    parents = spark.createDataFrame([(1,), (2,), (None,)], "key int")
    got = {(r.rule, r.key, r.n) for r in checks(rows, parents).collect()}
    assert got == {("id", "2", 2), ("pair", "x/y", 2), ("score", "2/a", 1), ("score", "/x", 1), ("score", "/", 1), ("parent", "3", 2), ("again", "3", 1)}
    assert checks(rows.limit(0), parents).count() == 0
    assert H.check_table(rows, unique={"id": ["id"]}).collect() == [("id", "2", 2)]
    with pytest.raises(ValueError, match="name of its own"):
        H.check_table(rows, unique={"id": ["id"]}, domains={"id": (["id"], F.lit(True))})


def test_one_scan_of_the_table(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, a string, b string, score int, parent int").write.parquet(f"{tmp_path}/rows")
    spark.range(3).write.parquet(f"{tmp_path}/parents")
    plan = checks(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/parents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/rows") == 1
    flagged = spark.read.parquet(f"{tmp_path}/rows").withColumn("flags", F.array("a"))
    assert H.flag_report(flagged)._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/rows") == 1


def test_flag_report_counts_rows_without_flags(spark):
    rows = spark.createDataFrame([(["A", "B"],), (["A"],), ([],), (None,)], "flags array<string>")
    assert [tuple(r) for r in H.flag_report(rows, ["B"]).collect()] == [("A", 2, 50, False), ("B", 1, 25, True)]
    assert H.flag_report(rows.limit(0)).collect() == []


def test_observed_rules(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (7,), (None,)], "score int")
    out, seen = H.observe_rules(rows, {"low": F.col("score") < 6, "odd": F.col("score") % 2 == 0})
    out.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"rows": 3, "low": 1, "odd": 2}
