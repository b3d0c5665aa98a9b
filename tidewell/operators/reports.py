"""Latency reports. A percentile is the element at floor(n * p) of the sorted values, the last at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import settled

POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def running(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """counts (by, value, c) with upto: how many values of the group are no larger. No group is sorted in one task.

    Values are dealt out in ranges; sums run inside each range of a group, and each range starts with the total of those before it.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = settled(counts.repartitionByRange(n, *by, value).withColumn("part", F.spark_partition_id()))
    totals = own.groupBy(*by, "part").agg(F.sum("c").alias("c"))
    inside = own.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "part").orderBy(value)))
    if by:
        before = F.sum("c").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = totals.select(*by, "part", F.coalesce(before, F.lit(0)).alias("before"))
    else:
        at, rows = 0, []
        for r in sorted(totals.collect()):  # a row for each range
            rows.append((r["part"], at))
            at += r["c"]
        starts = F.broadcast(own.sparkSession.createDataFrame(rows, "part int, before long"))
    return inside.join(starts, [*by, "part"]).withColumn("upto", F.col("upto") + F.col("before")).drop("part", "before")


def latencies(runs: DataFrame, value: str = "latency_ms", by: list[str] | None = None, points: dict[str, float] = POINTS) -> DataFrame:
    """n, min, the points, max and the integer mean, of each group. Values are counted first, so a group of any size costs its distinct values."""
    by = by or []
    run = running(runs.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")), value, by)
    total = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.sum(value) / F.count(F.lit(1))).cast("long").alias("avg"))
    both = run.join(total.select(*by, "n"), by) if by else run.crossJoin(F.broadcast(total.select("n")))  # one row
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    picked = both.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(k) for k, p in points.items()])
    out = total.join(picked, by) if by else total.crossJoin(picked)
    return out.select(*by, "n", "min", *points, "max", "avg")


def outcome(runs: DataFrame, seconds: float) -> DataFrame:
    """requests, success (status 200), failure and requests a second."""
    return runs.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 200).alias("success"), F.count_if(F.col("status") != 200).alias("failure"), F.round(F.count(F.lit(1)) / seconds, 2).alias("per_second"))


def markdown(report: DataFrame, heading: str = "Latency") -> str:
    """A report's single row as a Markdown table; it is one row whatever it reports on."""
    row = report.first().asDict()
    return f"# {heading}\n\n| Metric | Value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in row.items())
