"""Skew-safe ordered passes against plain sequential Python."""

import random

import pytest
from pyspark.sql import functions as F

from taplight.operators.ordered import (anchored_groups, bucketed, running, runs,
                                        trailing_series)


def make(spark, n=400, seed=1, span=3000.0, hot=0.5):
    """Rows in which one key holds about half."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < hot else f"k{rng.randrange(6)}",
             round(rng.uniform(0, span), 2), f"r{i:04d}", rng.randrange(10),
             rng.random() < 0.1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts double, id string, v int, stop boolean")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("bucket", [7.0, 250.0, 1e9])
def test_running(spark, bucket):
    rows, df = make(spark)
    out = running(bucketed(df, F.col("ts"), bucket), ["k"], ["ts", "id"], {
        "total": (F.col("v").cast("bigint"), "sum"), "top": (F.col("v"), "max"),
        "low": (F.col("v"), "min")})
    got = {r.id: (r.total, r.top, r.low) for r in out.collect()}
    want = {}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            seen = [x[3] for x in group[: i + 1]]
            want[r[2]] = (sum(seen), max(seen), min(seen))
    assert got == want


def test_running_exclusive(spark):
    rows, df = make(spark, 120)
    out = running(bucketed(df, F.col("ts"), 50.0), ["k"], ["ts", "id"],
                  {"total": (F.col("v").cast("bigint"), "sum")}, inclusive=False)
    got = {r.id: r.total for r in out.collect()}
    want = {r[2]: sum(x[3] for x in g[:i]) for g in by_key(rows).values() for i, r in enumerate(g)}
    assert got == want


@pytest.mark.parametrize("chunk", [5, 9, 100_000])
def test_trailing_series(spark, chunk):
    rows, df = make(spark)
    base = bucketed(df, F.col("ts"), 100.0)
    out = trailing_series(base, ["k"], ["ts", "id"], "v", 5, "s", chunk_rows=chunk)
    got = {r.id: r.s for r in out.collect()}
    assert got == {r[2]: [x[3] for x in g[max(0, i - 4): i + 1]]
                   for g in by_key(rows).values() for i, r in enumerate(g)}


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_trailing_series_of_eligible_rows(spark, chunk):
    rows, df = make(spark)
    out = trailing_series(bucketed(df, F.col("ts"), 100.0), ["k"], ["ts", "id"], "v", 4, "s",
                          eligible=F.col("v") >= 5, chunk_rows=chunk)
    got = {r.id: r.s for r in out.collect()}
    want = {}
    for group in by_key(rows).values():
        seen = []
        for r in group:
            if r[3] >= 5:
                seen = [*seen, r[3]][-4:]
            want[r[2]] = list(seen) or None
    assert got == want


def sequential_groups(rows, width, idle, use_stop):
    want = {}
    for group in by_key(rows).values():
        start = last = None
        closed = False
        for r in group:
            if start is None or closed or r[1] >= last + idle or r[1] >= start + width:
                start = r[1]
            want[r[2]] = start
            last, closed = r[1], use_stop and r[4]
    return want


@pytest.mark.parametrize("span_limit", [0, 20, 100_000])
@pytest.mark.parametrize("width,idle,stop", [(30.0, 15.0, True), (60.0, None, False)])
def test_anchored_groups(spark, span_limit, width, idle, stop):
    """Fold and pointer doubling give the same fixed-window groups."""
    rows, df = make(spark, 300, seed=5, span=900.0)
    out = anchored_groups(df, ["k"], "ts", ["ts", "id"], width, idle,
                          F.col("stop") if stop else None, name="g", bucket_seconds=40.0,
                          span_limit=span_limit)
    got = {r.id: r.g for r in out.collect()}
    assert got == sequential_groups(rows, width, idle or width, stop)


def test_runs_do_not_depend_on_buckets(spark):
    rows, df = make(spark, 200)
    seen = []
    for bucket in (3.0, 77.0, 1e9):
        out = runs(bucketed(df, F.col("ts"), bucket), ["k"], ["ts", "id"],
                   lambda prev: F.col("ts") >= prev["ts"] + 20)
        seen.append(sorted((r.id, r._run.id) for r in out.collect()))
    assert seen[0] == seen[1] == seen[2]
