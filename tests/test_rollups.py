"""Sketch roll-ups against exact values, and edges by page."""

import datetime as dt
import random

from pyspark.sql import functions as F

from watchfold.operators import graph, rollups


def calls(spark, count):
    draw = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=draw.randrange(7 * 3600)), int(draw.expovariate(0.001)), f"k{draw.randrange(3000)}") for _ in range(count)]
    rows += [(None, 1, "x"), (start, None, None)]
    return rows, spark.createDataFrame(rows, "at timestamp, ms int, who string")


def test_minute_sketches_merge_to_hours_and_days(spark):
    rows, df = calls(spark, 20_000)
    minutes = rollups.slots(df, "at", "ms", "who")
    for window, length in (("hour", 13), ("day", 10)):
        found = rollups.merged(minutes, "minute", window)
        exact = {}
        for at, ms, who in rows:
            if at is not None:
                exact.setdefault(str(at)[:length], []).append((ms, who))
        got = found.select(F.col("slot").cast("string").alias("s"), "n", rollups.quantile(0.5).alias("p50"), rollups.distinct().alias("who")).collect()
        assert {r.s[:length]: r.n for r in got} == {k: len(v) for k, v in exact.items()}
        for r in got:
            values = sorted(ms for ms, _ in exact[r.s[:length]] if ms is not None)
            low, high = sum(v < r.p50 for v in values) / len(values), sum(v <= r.p50 for v in values) / len(values)
            assert low - rollups.KLL_ERROR <= 0.5 <= high + rollups.KLL_ERROR
            who = len({w for _, w in exact[r.s[:length]] if w is not None})
            assert abs(r.who - who) <= rollups.HLL_ERROR * who


def test_slots_without_values(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, None)], "at timestamp, ms int, who string")
    row = rollups.merged(rollups.slots(df, "at", "ms", "who"), "minute", "hour").select("n", rollups.quantile(0.5).alias("p"), rollups.distinct().alias("d")).first()
    assert tuple(row) == (1, None, 0)
    assert rollups.merged(rollups.slots(df.limit(0), "at", "ms", "who"), "minute", "day").count() == 0


def test_edge_pages_cover_all_edges_once(spark):
    draw = random.Random(2)
    rows = [("hot" if i % 3 else f"i{i % 7}", i, draw.choice(["attacker", "victim", "pivot", "context"])) for i in range(60)]
    df = spark.createDataFrame(rows, "incident_id string, position bigint, role string")
    whole = [(i, e, a, b) for i in sorted({r[0] for r in rows}) for e, (src, dst, _) in sorted(graph.EDGE_CLASSES.items())
             for k, a, p in rows if k == i and p == src for m, b, q in rows if m == i and q == dst]
    got = [tuple(r) for first in range(0, len(whole) + 100, 150) for r in sorted(graph.edge_page(df, first, 150, parts=3).collect())]
    assert got == [(n, *edge) for n, edge in enumerate(whole)]
    assert graph.edge_page(df.limit(0), 0, 10).count() == 0
