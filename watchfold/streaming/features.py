"""Behavioural features of a stream, exact, on keyed state that Spark keeps, bounds and restores.

Four stateful operators follow one another; each knows its key only, and none holds more than one horizon:

* the clock (one key) receives counts per second, not events, and keeps the 24 hour counters; for every second it
  tells where the running time-of-day statistics stand;
* seconds (keyed by a hash of the second) number the events of each second over all entities; they keep nothing;
* places (keyed by entity) keep the last located event of the latest slots, and tell every slot what was before it;
* slots (keyed by entity and 300 s slot) keep the events of the slot, of the slot before and of the slot one hour
  earlier, and the counts in between, and compute the features of new events. A timer at the end of the slot, in
  event time, clears them once the watermark has passed.

Events travel packed, one row per key and Arrow batch, so a busy key is few rows. Events are taken in event-time
order within a micro-batch; micro-batches in arrival order. An event whose slot the watermark has passed is given
back as late, without features, and nothing is lost without a trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import HOUR_SLOTS, SLOT, _speed, _zscore, feature_rows
from ..settings import MICROS, WINDOW_1H, WINDOW_1M, WINDOW_5M

# What a packed row holds.
OWN, PREVIOUS, HOUR_AGO, BETWEEN, PLACE = range(5)
SECOND_KEYS = 256
# Rows that leave an operator as one frame; what a key holds stays in Arrow, a fraction of the size.
PIECE = 20_000
PLACE_NAMES = ["place_us", "place_tie", "place_lat", "place_lon"]
PLACE_FIELDS = "place_us long, place_tie long, place_lat double, place_lon double"


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    batch = table.combine_chunks().to_batches()[0] if isinstance(table, pa.Table) else table
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column as an array; nulls become NaN."""
    return table.column(column).to_numpy()


def pieces(table: pa.Table, order: np.ndarray, added: dict, columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a table in the given order, with ``added`` columns that follow that order, as bounded frames."""
    for at in range(0, len(order), PIECE):
        here = slice(at, at + PIECE)
        yield table.take(pa.array(order[here])).to_pandas().assign(**{c: v[here] for c, v in added.items()})[columns]


def groups_of(batch: pa.RecordBatch, *keys: pd.Series | np.ndarray) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch by key, in their order."""
    codes = pd.MultiIndex.from_arrays(keys).factorize()
    order = np.argsort(codes[0], kind="stable")
    ends = np.cumsum(np.bincount(codes[0], minlength=len(codes[1])))
    ordered = batch.take(pa.array(order))
    at = 0
    for key, end in zip(codes[1], ends.tolist()):
        yield key, ordered.slice(at, end - at)
        at = end


# The clock.

def _seconds_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        second, n = np.unique(batch.column(0).to_numpy() // MICROS, return_counts=True)
        if len(second):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(second), dtype=np.int32)), pa.array(second), pa.array(n.astype(np.int64))],
                                             ["clock", "sec", "n"])


class Clock(StatefulProcessor):
    """Running time-of-day statistics: 24 counters and their spread D; for each second where it begins."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hours", "counts array<double>, d double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).groupby("sec")["n"].sum().sort_index()
        counts, d = ([0.0] * 24, 0.0) if not self.state.exists() else self.state.get()
        counts, out = list(counts), []
        for hour, in_hour in every.groupby(every.index // 3600):
            hod = int(hour % 24)
            r0, n0, c = counts[hod], sum(counts), float(in_hour.sum())
            out.append(pd.DataFrame({"sec": in_hour.index, "j0": in_hour.cumsum().to_numpy() - in_hour.to_numpy(), "r0": r0, "n0": n0, "d0": d}))
            d += 2 * c * (24 * r0 - n0) + 23 * c * c
            counts[hod] += c
        self.state.update((counts, d))
        yield pd.concat(out)

    def close(self) -> None:
        pass


# Seconds.

def _packed_seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        second = batch.column(batch.schema.get_field_index("us")).to_numpy() // MICROS
        found = [(int(k[0]), pack(b)) for k, b in groups_of(batch, second % SECOND_KEYS)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["part", "rows"])


class Seconds(StatefulProcessor):
    """Numbers events within their second and adds where the second begins."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blobs, starts = [], []
        for some in rows:
            packed = some["rows"].notna().to_numpy()
            blobs += some["rows"][packed].tolist()
            starts.append(some.loc[~packed, ["sec", "j0", "r0", "n0", "d0"]].to_numpy(dtype=float))
        begins = np.concatenate(starts)
        begins = begins[np.argsort(begins[:, 0])]
        events = unpack(blobs)
        del blobs
        order = np.lexsort((numbers(events, "tie"), numbers(events, "us")))
        second = numbers(events, "us")[order] // MICROS
        at = np.searchsorted(begins[:, 0], second)
        number = np.arange(1, len(second) + 1) - np.searchsorted(second, second)
        yield from pieces(events, order, {"j": number, "j0": begins[at, 1].astype(np.int64), "r0": begins[at, 2], "n0": begins[at, 3],
                                          "d0": begins[at, 4]}, self.columns)

    def close(self) -> None:
        pass


# Places.

def _last_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        df = batch.to_pandas()
        last = df.sort_values(["us", "tie"], kind="stable").groupby(["entity", "slot"], as_index=False).last()
        if len(last):
            yield pa.RecordBatch.from_pandas(last[["entity", "slot", "us", "tie", "lat", "lon"]], preserve_index=False)


class Places(StatefulProcessor):
    """For every slot with located events, the last located event of earlier slots."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("places", "slot array<long>, us array<long>, tie array<long>, lat array<double>, lon array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[["slot", "us", "tie", "lat", "lon"]]
        known = fresh.iloc[:0] if not self.state.exists() else pd.DataFrame(dict(zip(fresh.columns, self.state.get())))
        every = pd.concat([known, fresh]) if len(known) else fresh
        every = every.sort_values(["slot", "us", "tie"], kind="stable").groupby("slot", as_index=False).last()
        # The latest slots that may still receive events, and the last one before them.
        kept = every.tail(2 * HOUR_SLOTS)
        self.state.update(tuple(kept[c].tolist() for c in kept.columns))
        before = every.shift(1)
        touched = every["slot"].isin(fresh["slot"]) & before["us"].notna()
        if touched.any():
            at = before[touched]
            yield pd.DataFrame({"entity": key[0], "slot": every["slot"][touched], "place_us": at["us"].astype("int64"),
                                "place_tie": at["tie"].astype("int64"), "place_lat": at["lat"], "place_lon": at["lon"]})

    def close(self) -> None:
        pass


# Slots.

def _packed_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own events, what later slots need of them, and their number for the slots in between."""
    for batch in batches:
        entity = batch.column(batch.schema.get_field_index("entity")).to_pandas()
        slot = batch.column(batch.schema.get_field_index("slot")).to_numpy()
        out = []
        for (e, s), rows in groups_of(batch, entity, slot):
            s = int(s)
            us, fail = rows.column(rows.schema.get_field_index("us")), rows.column(rows.schema.get_field_index("fail"))
            thin = pack(pa.RecordBatch.from_arrays([us, fail], ["us", "fail"]))
            out += [(e, s, OWN, pack(rows), None), (e, s + 1, PREVIOUS, thin, None), (e, s + HOUR_SLOTS, HOUR_AGO, thin, None)]
            out += [(e, s + k, BETWEEN, None, len(us)) for k in range(2, HOUR_SLOTS)]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                                         ["entity", "slot", "kind", "rows", "n"])


def _chunk(kind, rows, n, us, tie, lat, lon) -> tuple:
    """One packed row with values only where its kind has them."""
    told = (int(us), int(tie), float(lat), float(lon)) if kind == PLACE else (None,) * 4
    return int(kind), bytes(rows) if kind in (OWN, PREVIOUS, HOUR_AGO) else None, int(n) if kind == BETWEEN else None, *told


class Slots(StatefulProcessor):
    """Features of one entity's events in one slot."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Everything a key has received, as it came.
        self.chunks = handle.getListState("chunks", f"kind int, rows binary, n long, {PLACE_FIELDS}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [_chunk(*row) for some in rows for row in some[["kind", "rows", "n", *PLACE_NAMES]].itertuples(index=False, name=None)]
        own = any(c[0] == OWN for c in fresh)
        end_ms = (int(key[1]) + 1) * SLOT * 1000
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            if own:
                gone = unpack([c[1] for c in fresh if c[0] == OWN])
                for at in range(0, gone.num_rows, PIECE):
                    yield gone.slice(at, PIECE).to_pandas().assign(late=True).reindex(columns=self.columns)
            return
        known = [tuple(c) for c in self.chunks.get()] if own else []
        if not (known or self.chunks.exists()):
            self.handle.registerTimer(end_ms)
        self.chunks.appendList(fresh)
        if own:
            yield from self._features(known, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        return iter([])

    def _features(self, known: list[tuple], fresh: list[tuple]) -> Iterator[pd.DataFrame]:
        def of(kind: int, *parts: list[tuple]) -> list[bytes]:
            return [bytes(c[1]) for part in parts for c in part if c[0] == kind]

        between = sum(c[2] for c in known + fresh if c[0] == BETWEEN)
        place = max((tuple(c[3:]) for c in known + fresh if c[0] == PLACE), default=None)

        def thin(kind: int) -> tuple[np.ndarray, np.ndarray]:
            blobs = of(kind, known, fresh)
            if not blobs:
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            table = unpack(blobs)
            order = np.argsort(numbers(table, "us"), kind="stable")
            return numbers(table, "us")[order], numbers(table, "fail")[order]

        events = unpack(of(OWN, known, fresh))
        old = sum(pa.ipc.open_stream(b).read_all().num_rows for b in of(OWN, known))
        order = np.lexsort((numbers(events, "tie"), numbers(events, "us")))
        events, new = events.take(order), order >= old
        before, before_fail = thin(PREVIOUS)
        before_fails = np.concatenate([[0], np.cumsum(before_fail)])
        hour_ago, _ = thin(HOUR_AGO)

        us = numbers(events, "us")
        seen = np.arange(1, len(us) + 1)
        minute_ago = us - WINDOW_1M * MICROS
        # The slot is as long as the middle window, so all of its events so far are within it.
        last_minute = seen - np.searchsorted(us, minute_ago) + len(before) - np.searchsorted(before, minute_ago)
        from_5m = np.searchsorted(before, us - WINDOW_5M * MICROS)
        last_5m = seen + len(before) - from_5m
        failed = np.cumsum(numbers(events, "fail")) + before_fails[-1] - before_fails[from_5m]
        last_hour = seen + len(before) + between + len(hour_ago) - np.searchsorted(hour_ago, us - WINDOW_1H * MICROS)

        def spread(column: str) -> np.ndarray:
            """Distinct values so far: first occurrences, summed up."""
            coded = events.column(column).combine_chunks().dictionary_encode().indices
            at = np.flatnonzero(coded.is_valid())
            _, first = np.unique(coded.drop_null().to_numpy(), return_index=True)
            flags = np.zeros(len(us))
            flags[at[first]] = 1
            return np.cumsum(flags)

        # The last located event before each one, or the one before the slot.
        located = ~np.isnan(numbers(events, "lat"))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(located, np.arange(len(us)), -1))[:-1]])
        places = {}
        for i, (name, source) in enumerate(zip(PLACE_NAMES, ("us", "tie", "lat", "lon"))):
            values = np.where(last >= 0, numbers(events, source)[last], np.nan if place is None else place[i])
            places[name] = pd.array(values, dtype="Int64") if source == "us" else values
        added = dict(
            event_count_1m=last_minute.astype(float), event_count_5m=last_5m.astype(float), event_count_1h=last_hour.astype(float),
            failed_auth_ratio=failed / np.maximum(last_5m, 1), distinct_dest_ports=spread("dport"), dest_ip_fanout=spread("dip"),
            bytes_transferred=np.cumsum(numbers(events, "nbytes")).astype(float), **places, late=np.zeros(len(us), dtype=bool))
        at = np.flatnonzero(new)
        yield from pieces(events, at, {c: v[at] for c, v in added.items()}, self.columns)

    def close(self) -> None:
        pass


def feature_stream(events: DataFrame, *carry: str | Column, delay: str = "10 minutes") -> DataFrame:
    """id, ``carry``, entity, us, the nine features and ``late`` of every event of a stream.

    The values are those of `extract_features` over all events that arrived so far. ``delay`` is how far event
    time may lag; an event whose slot lies before the watermark is ``late`` and its features are null.
    Needs the RocksDB state store and append mode.
    """
    narrow = feature_rows(events, *carry).drop("slot")
    # The watermark stays in the plan, but its column does not: late rows are to reach the slots.
    rows = narrow.withColumn("_time", F.timestamp_micros("us")).withWatermark("_time", delay).drop("_time")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    started = {"j": "long", "j0": "long", "r0": "double", "n0": "double", "d0": "double"}
    numbered = ", ".join(f"`{c}` {t}" for c, t in {**types, **started}.items())
    clock = rows.select("us").mapInArrow(_seconds_of_batches, "clock int, sec long, n long").groupBy("clock").transformWithStateInPandas(
        Clock(), "sec long, j0 long, r0 double, n0 double, d0 double", "append", "None")
    starts = clock.withColumn("part", F.pmod("sec", F.lit(SECOND_KEYS)))
    packed = rows.mapInArrow(_packed_seconds, "part long, rows binary")
    seconds = packed.unionByName(starts, allowMissingColumns=True).groupBy("part").transformWithStateInPandas(
        Seconds([*types, *started]), numbered, "append", "None")
    scored = seconds.withColumn("tod_zscore", _zscore()).drop(*started)

    slot = F.call_function("div", F.col("us") - F.pmod("us", F.lit(SLOT * MICROS)), F.lit(SLOT * MICROS)).alias("slot")
    located = rows.filter(F.col("lat").isNotNull()).select("entity", slot, "us", "tie", "lat", "lon")
    places = located.mapInArrow(_last_places, "entity string, slot long, us long, tie long, lat double, lon double").groupBy(
        "entity").transformWithStateInPandas(Places(), f"entity string, slot long, {PLACE_FIELDS}", "append", "None")
    told = places.withColumn("kind", F.lit(PLACE))

    own = scored.select("*", slot).mapInArrow(_packed_slots, "entity string, slot long, kind int, rows binary, n long")
    carried = [c for c in rows.columns if c not in {"tie", "fail", "dport", "dip", "nbytes", "lat", "lon"}]
    features = ["event_count_1m", "event_count_5m", "event_count_1h", "failed_auth_ratio", "distinct_dest_ports", "dest_ip_fanout", "bytes_transferred"]
    kept = {**{c: types[c] for c in carried}, "lat": "double", "lon": "double", "tod_zscore": "double", **dict.fromkeys(features, "double"),
            "place_us": "long", "place_lat": "double", "place_lon": "double", "late": "boolean"}
    out = own.unionByName(told, allowMissingColumns=True).groupBy("entity", "slot").transformWithStateInPandas(
        Slots(list(kept)), ", ".join(f"`{c}` {t}" for c, t in kept.items()), "append", "EventTime")
    place = F.when(F.col("place_us").isNotNull(), F.struct(F.col("place_us").alias("us"), F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon")))
    speed = out.withColumn("place", place).withColumn("geo_velocity_kmh", F.coalesce(_speed(), F.lit(0.0)))
    return speed.select(*carried, *[F.when(~F.col("late"), F.col(c)).alias(c) for c in [*features, "tod_zscore", "geo_velocity_kmh"]], "late")
