"""Features against a plain sequential restatement on random events with ties, boundary gaps and
shuffled input, and on one entity that holds most events."""

import math
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchfold.operators.events import event_columns
from watchfold.operators.features import busy_keys, entity_features, extract_features, feature_rows, with_tod_zscore
from watchfold.operators.ranks import first_of_each, ordered_parts, running
from watchfold.schema import FEATURES
from watchfold.streaming import features as streaming
from watchfold.streaming.feeds import run_available
from watchfold.streaming.features import feature_stream

HEADER = "id string, ts double, ip string, user string, fail boolean, port int, dip string, nbytes bigint, lat double, lon double"


def events(spark, rows):
    df = spark.createDataFrame(rows, HEADER)
    return df.select(*event_columns({
        "id": F.col("id"), "timestamp_unix": F.col("ts"), "source.ip": F.col("ip"), "user.name": F.col("user"),
        "event.outcome": F.when(F.col("fail"), "failure").otherwise("success"), "destination.port": F.col("port"),
        "destination.ip": F.col("dip"), "network.bytes": F.col("nbytes"),
        "source.geo.latitude": F.col("lat"), "source.geo.longitude": F.col("lon")}))


def sequential(rows):
    out, seen, places, hours = {}, {}, {}, [1] * 24
    for r in sorted(rows, key=lambda r: (round(r[1] * 1e6), int(r[0]))):
        i, ts, ip, user, fail, port, dip, nbytes, lat, lon = r
        entity = ip or user or "unknown"
        mine = seen.setdefault(entity, [])
        mine.append(r)

        def within(w):
            return [x for x in mine if round(x[1] * 1e6) >= round(ts * 1e6) - w * 1_000_000]
        five = within(300)
        bucket = [x for x in mine if x[1] // 300 == ts // 300]
        h = int(ts // 3600) % 24
        hours[h] += 1
        mean = sum(hours) / 24
        std = math.sqrt(max(sum(c * c for c in hours) / 24 - mean * mean, 0)) or 1.0
        speed = 0.0
        if lat is not None and lon is not None:
            if entity in places:
                a, b, t = places[entity]
                x = (math.sin(math.radians(lat - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat))
                     * math.sin(math.radians(lon - b) / 2) ** 2)
                speed = 6371.0 * 2 * math.asin(math.sqrt(min(x, 1))) / max((round(ts * 1e6) - round(t * 1e6)) / 1e6, 1.0) * 3600
            places[entity] = (lat, lon, ts)
        out[i] = [len(within(60)), len(five), len(within(3600)), sum(x[4] for x in five) / max(len(five), 1),
                  len({x[5] for x in bucket if x[5]}), len({x[6] for x in bucket if x[6]}), sum(x[7] for x in bucket),
                  (hours[h] - mean) / std, speed]
    return out


def random_rows(n, seed, hot):
    rng = random.Random(seed)
    ts, rows = 1_700_000_000.0 - 1_700_000_000.0 % 300, []
    for i in range(n):
        ts += rng.choice([0, 0, 0.5, 1, 59, 60, 60.000001, 299, 300, 300.000001, 3300, 7]) * (0.2 if hot else 1)
        ts = round(ts, 6)
        ip = "10.0.0.1" if rng.random() < hot else rng.choice(["10.0.0.2", "", None, "10.0.0.3"])
        located = rng.random() < 0.4
        rows.append((str(i), ts, ip, rng.choice(["bob", None]), rng.random() < 0.3, rng.choice([None, 0, 22, 80, 443]),
                     rng.choice([None, "", "1.1.1.1", "2.2.2.2"]), rng.randrange(1000),
                     rng.uniform(-80, 80) if located else None, rng.uniform(-170, 170) if located else None))
    return rows


def compare(got, expected):
    assert got.keys() == expected.keys()
    for i, want in expected.items():
        assert got[i] == pytest.approx(want, rel=1e-7, abs=1e-7), i


@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.3), (3, 0.95)])
def test_against_sequential(spark, seed, hot):
    rows = random_rows(400, seed, hot)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    got = {r.id: [r[c] for c in FEATURES] for r in extract_features(events(spark, shuffled)).collect()}
    compare(got, sequential(rows))


def nine(df):
    rows = df.collect()
    got = {r.id: [r[c] for c in FEATURES] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed, hot, split, part", [(4, 0.3, 0, 50), (5, 0.95, 40, 30), (6, 0.9, 5, 10_000)])
def test_busy_entities_and_seconds_cut_into_parts(spark, seed, hot, split, part):
    rows = random_rows(400, seed, hot)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    compare(nine(extract_features(events(spark, shuffled), split_rows=split, part_rows=part)), sequential(rows))


def test_one_instant_of_one_entity(spark):
    """All rows bear one timestamp: only the arrival order tells them apart."""
    rows = [(str(i), 1_700_000_000.25, "10.0.0.1", None, i % 3 == 0, i % 7, f"1.1.1.{i % 11}", i, None if i % 2 else i % 60 - 30.0,
             None if i % 2 else i % 90 - 45.0) for i in range(3000)]
    compare(nine(extract_features(events(spark, rows), split_rows=100, part_rows=400)), sequential(rows))


def test_no_part_holds_much_more_than_asked_for(spark):
    """One entity and one instant of 40,000 rows: rows per part stay near the asked size, and follow the order."""
    rows = spark.range(40_000).selectExpr("'e' as entity", "1 as t", "id as tie")
    placed = ordered_parts(rows, ["entity"], ["t", "tie"], 20)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 3 * 2_000
    spans = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.min("tie"), F.max("tie")).collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_repeated_rows_are_counted_apart(spark):
    rows = spark.createDataFrame([("e", 1, 5, "x")] * 6 + [("e", 2, 1, "y"), (None, 1, 1, "x")], "k string, t int, tie int, v string")
    placed = ordered_parts(rows, ["k"], ["t", "tie"], 4)
    got = running(placed, ["k"], ["t", "tie"], {"n": F.lit(1)}, {"before": F.col("v")}).select("k", "n", "before").collect()
    assert sorted((r.k or "", r.n, r.before or "") for r in got) == [
        ("", 1, ""), ("e", 1, ""), *[("e", i, "x") for i in range(2, 8)]]
    assert first_of_each(placed, ["k"], ["t", "tie"], "v").count() == 3


def test_tables_without_busy_keys_are_left_as_they_are(spark):
    rows = feature_rows(events(spark, random_rows(60, 3, 0.5)))
    assert busy_keys(rows, 1000) == (None, None)
    entities, seconds = busy_keys(rows, 2)
    assert {r.entity for r in entities.collect()} and all(r.n > 2 for r in (seconds.collect() if seconds else []))


def replayed(spark, root, steps):
    """The stream over steps of rows, restarted after each; all its output so far."""
    for rows in steps:
        frame = events(spark, rows or [next(iter(filter(None, steps)))[0]])
        (frame if rows else frame.filter("false")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = feature_stream(spark.readStream.schema(frame.schema).parquet(f"{root}/in"))
        run_available(stream, f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out")


def test_micro_batches_equal_one_batch(spark, tmp_path):
    rows = random_rows(240, 7, 0.5)
    ordered = sorted(rows, key=lambda r: (r[1], int(r[0])))
    cuts = [0, 60, 61, 150, 240]
    out = replayed(spark, str(tmp_path), [ordered[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    assert out.filter("late").count() == 0
    compare(nine(out), sequential(rows))


def test_late_rows_are_told_apart(spark, tmp_path):
    """Rows within the delay still count; rows whose slot is over are given back without features."""
    def row(i, ts, port=22):
        return (str(i), 1_700_000_100.0 + ts, "10.0.0.1", None, False, port, "1.1.1.1", 5, None, None)
    steps = [[row(1, 0), row(2, 10)], [row(3, 4000)], [row(4, 20), row(5, 3990, 80), row(6, 4001)], [row(7, 4002)]]
    out = {r.id: r for r in replayed(spark, str(tmp_path), steps).collect()}
    assert {i for i, r in out.items() if r.late} == {"4"}
    assert out["4"].event_count_1m is None and out["4"].tod_zscore is None
    assert [out[i].event_count_1m for i in ("1", "2", "3", "5", "6", "7")] == [1, 2, 1, 1, 3, 4]
    assert (out["6"].distinct_dest_ports, out["6"].bytes_transferred) == (2, 15)


def test_state_is_cleared_behind_the_watermark(spark, tmp_path):
    """Slots of passed hours leave the state, however many steps come."""
    root, kept = str(tmp_path), []
    for step in range(4):
        rows = [(str(100 * step + i), 1_700_000_100.0 + step * 7200 + i, f"10.0.0.{i % 3}", None, False, 22, "1.1.1.1", 5, 1.0, 2.0) for i in range(30)]
        frame = events(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = feature_stream(spark.readStream.schema(frame.schema).parquet(f"{root}/in"))
        query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").option(
            "path", f"{root}/out").start()
        query.awaitTermination()
        kept.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    assert spark.read.parquet(f"{root}/out").count() == 120
    assert kept[-1] <= kept[0] * 1.5


def test_large_tables_are_dealt_by_their_number_of_rows(spark):
    """Small partitions are not joined up to Spark's target size, so a task's rows do not grow with the table."""
    base = feature_rows(events(spark, random_rows(300, 9, 0.5)))
    many = entity_features(with_tod_zscore(base, n_rows=3_000_000), base, n_rows=3_000_000)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(sec#\d+L, 12\), REPARTITION_BY_NUM", plan)
    assert re.search(r"hashpartitioning\(entity#\d+, slot#\d+L, 36\), REPARTITION_BY_NUM", plan)
    few = entity_features(with_tod_zscore(base), base)
    assert sorted(many.select("id", *FEATURES).collect()) == sorted(few.select("id", *FEATURES).collect())


def test_frames_that_leave_the_seconds_are_bounded(monkeypatch):
    monkeypatch.setattr(streaming, "PIECE", 7)
    us = [1_000_000 * (i // 4) + 50 - i for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"us": us, "tie": list(range(40))})
    begins = pd.DataFrame({"rows": None, "sec": range(-1, 10), "j0": range(-1, 10), "r0": 1.0, "n0": 2.0, "d0": 3.0})
    rows = pd.DataFrame({"rows": [streaming.pack(batch.slice(0, 25)), streaming.pack(batch.slice(25))]}).reindex(columns=begins.columns)
    frames = list(streaming.Seconds(["us", "tie", "j", "j0"]).handleInputRows((0,), iter([begins, rows]), None))
    assert [len(f) for f in frames] == [7, 7, 7, 7, 7, 5]
    out = pd.concat(frames)
    assert out["us"].tolist() == sorted(us)
    assert out["j"].tolist() == [i % 4 + 1 for i in range(40)]
    assert out["j0"].tolist() == [i // 4 for i in range(40)]
