import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators.running import default_buckets, running, with_range_bucket


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_sums_maxima_and_totals_against_a_loop(spark, buckets):
    draw = random.Random(3)
    rows = [
        ("hot" if i % 3 else draw.choice(["a", None]), draw.randint(0, 400), i, draw.randint(-5, 9))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "k string, t int, id long, v int")
    out = running(
        df,
        keys=["k"],
        order=["t", "id"],
        sums={"total": F.col("v"), "rank": F.lit(1)},
        maxima={"best": F.col("v")},
        totals={"all": "total"},
        buckets=buckets,
    )
    found = {r["id"]: (r["total"], r["rank"], r["best"], r["all"]) for r in out.collect()}
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    assert len(found) == len(rows)
    for group in groups.values():
        total, best, everything = 0, None, sum(r[3] for r in group)
        for n, (_, _, i, v) in enumerate(sorted(group, key=lambda r: r[1:3]), 1):
            total, best = total + v, v if best is None else max(best, v)
            assert found[i] == (total, n, best, everything)


def test_buckets_ascend_and_stay_small_when_one_key_has_every_row(spark):
    rows = 50_000
    df = spark.range(rows).select(
        F.lit("only").alias("k"), "id", F.pow(F.col("id"), F.lit(3.0)).alias("t")
    )
    tagged = with_range_bucket(df, ["t"], ["id"])
    spans = (
        tagged.groupBy("_bucket")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
        .orderBy("_bucket")
        .collect()
    )
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))
    assert len(spans) > default_buckets(df) / 2
    assert max(s["n"] for s in spans) < 10 * rows / default_buckets(df)


def test_bucket_edges_are_the_same_in_every_run(spark):
    df = spark.range(5000).select("id", F.rand(5).alias("t"))
    written = df.repartition(7).cache()
    first = {r["id"]: r["_bucket"] for r in with_range_bucket(written, ["t"], ["id"]).collect()}
    shuffled = written.repartition(3, "t")
    second = {r["id"]: r["_bucket"] for r in with_range_bucket(shuffled, ["t"], ["id"]).collect()}
    assert first == second


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t int, v int")
    assert running(df, keys=["k"], order=["t"], sums={"s": F.col("v")}).collect() == []


def test_one_scan_serves_edges_totals_and_rows(spark, folder):
    from plumbline.plans.queries import QUERIES

    df = QUERIES["price_average_precision"](spark, folder)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 1
    assert "ReusedExchange" in final
    assert "Cartesian" not in plan and "NestedLoop" not in plan
