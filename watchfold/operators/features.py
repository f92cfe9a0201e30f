"""Nine behavioural features per event, exact, without any unbounded group.

All counters are defined over one entity's events in arrival order. Partitioning by entity alone
would put a hot entity into one task, so the work is split by (entity, 300 s slot):

* every event is also sent, as a thin context row, to the next slot (for the 1 m and 5 m windows
  that reach back into it) and to the slot one hour later (for the tail of the 1 h window);
* what lies in whole slots between comes from a small per-slot table;
* the last located event before a slot comes from the same table.

So one shuffle on (entity, slot) serves all entity features, and a group is bounded by one
entity's events in five minutes. The time-of-day feature is global and uses a one-second split.

Where a count shows that an entity's slot or a second holds more than ``SPLIT_ROWS`` rows, these
entities and seconds take another way: their rows, and for each of them a row at the instant it
leaves each window, are cut into parts of about equal size along (entity, time, arrival), whatever
the keys. Every feature is then a running sum over that order (entered minus left), a running
count of first occurrences, or the last value before; each part adds what the parts before it
amount to. So not even one entity whose events all bear one timestamp meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, latitude, longitude, speed_kmh
from ..functions.keys import entity_feature, epoch_bucket, event_micros, tie_breaker
from ..settings import MICROS, WINDOW_1H, WINDOW_1M, WINDOW_5M
from .ranks import _equal, dealt, first_of_each, ordered_parts, running, salted_join
from ..session import reliable

SLOT = WINDOW_5M
HOUR_SLOTS = WINDOW_1H // SLOT
OWN, PREVIOUS, HOUR_AGO = 0, 1, 2
LEFT, ENTERED = 0, 1
SPLIT_ROWS = 200_000
PART_ROWS = 100_000


def feature_rows(events: DataFrame, *carry: str | Column) -> DataFrame:
    """The narrow columns the features need; ``carry`` columns travel along unchanged."""
    lat, lon = latitude(), longitude()
    located = lat.isNotNull() & lon.isNotNull()
    return events.select(
        "id", *carry,
        entity_feature().alias("entity"),
        event_micros().alias("us"),
        tie_breaker("id").alias("tie"),
        (F.coalesce(F.col("event.outcome"), F.lit("")) == "failure").cast("int").alias("fail"),
        F.when(F.col("destination.port") != 0, F.col("destination.port")).alias("dport"),
        F.when(F.col("destination.ip") != "", F.col("destination.ip")).alias("dip"),
        F.coalesce(F.col("network.bytes"), F.lit(0)).alias("nbytes"),
        F.when(located, lat).alias("lat"), F.when(located, lon).alias("lon"),
    ).withColumn("slot", epoch_bucket("us", SLOT))


def slot_table(rows: DataFrame) -> DataFrame:
    """Per (entity, slot): events in the 12 slots before it, and the last located event before it.

    Its size is bounded by entities x slots, whatever the event rate; the first aggregation
    combines on the map side.
    """
    place = F.struct("us", "tie", "lat", "lon")
    per_slot = rows.groupBy("entity", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("lat").isNotNull(), place)).alias("place"))
    by_slot = W.partitionBy("entity").orderBy("slot")
    return per_slot.select(
        "entity", "slot",
        F.coalesce(F.sum("n").over(by_slot.rangeBetween(-HOUR_SLOTS, -1)), F.lit(0)).alias("n_before"),
        F.last("place", ignorenulls=True).over(
            by_slot.rowsBetween(W.unboundedPreceding, -1)).alias("place_before"))


def _with_context(rows: DataFrame) -> DataFrame:
    """Each event as itself and as two context rows whose payload is dropped."""
    hour = WINDOW_1H * MICROS
    copies = F.array(
        F.struct(F.lit(OWN).alias("kind"), F.col("slot").alias("at"), F.col("us").alias("t")),
        F.struct(F.lit(PREVIOUS).alias("kind"), (F.col("slot") + 1).alias("at"), F.col("us").alias("t")),
        F.struct(F.lit(HOUR_AGO).alias("kind"), (F.col("slot") + HOUR_SLOTS).alias("at"),
                 (F.col("us") + hour).alias("t")))
    own = F.col("kind") == OWN
    keep = {"entity", "tie", "fail", "kind", "t"}
    out = rows.select("*", F.explode(copies).alias("_c")).select(
        *rows.columns, "_c.kind", F.col("_c.at").alias("_at"), F.col("_c.t").alias("t"))
    cols = [F.col(c) if c in keep else F.when(own, F.col(c)).alias(c)
            for c in rows.columns if c != "slot"]
    return out.select(*cols, "kind", F.col("_at").alias("slot"), "t")


def entity_features(rows: DataFrame, base: DataFrame | None = None, places: DataFrame | None = None,
                    n_rows: int | None = None) -> DataFrame:
    """Add the eight per-entity features to ``feature_rows`` output.

    ``base`` gives the same events without added columns, so that the slot table does not repeat
    the work behind them. ``places`` (entity, known_place) gives the last located event of an
    entity before all of these rows. ``n_rows`` is their number, or above it; counted if not given.
    """
    if n_rows is None:
        n_rows = (rows if base is None else base).count()
    own = F.col("kind") == OWN
    near = F.col("kind") != HOUR_AGO
    group = ["entity", "slot"]
    # The windows below differ in their finer keys; placing rows by (entity, slot) up front lets
    # all of them run on this one shuffle.
    expanded = dealt(_with_context(rows), group, 3 * n_rows)

    # First occurrence of each port and address in the slot.
    def first_seen(c: str) -> Column:
        w = W.partitionBy(*group, c).orderBy("t", "tie")
        return (own & F.col(c).isNotNull() & (F.row_number().over(w) == 1)).cast("int")

    flagged = (expanded.withColumns({"new_port": first_seen("dport"), "new_ip": first_seen("dip"),
                                     "late": (~near).cast("int")})
                       .drop("dport", "dip"))

    # Equal times: events first, in arrival order, then hour-old context, which leaves the
    # window only once it is strictly older than one hour.
    order = W.partitionBy(*group).orderBy("t", "late", "tie", "kind")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    located = own & F.col("lat").isNotNull()
    near_fail = F.when(near, F.col("fail")).otherwise(0)
    ranked = flagged.withColumns({
        "seen": F.count(F.when(near, 1)).over(upto),
        "seen_fail": F.sum(near_fail).over(upto),
        "seen_own": F.count(F.when(own, 1)).over(upto),
        "gone_1h": F.count(F.when(~near, 1)).over(upto),
        "distinct_dest_ports": F.sum("new_port").over(upto).cast("double"),
        "dest_ip_fanout": F.sum("new_ip").over(upto).cast("double"),
        "bytes_transferred": F.sum(F.when(own, F.col("nbytes")).otherwise(0)).over(upto).cast("double"),
        "place_in_slot": F.last(F.when(located, F.struct("us", "tie", "lat", "lon")),
                                ignorenulls=True).over(before),
    })

    # A second step, so that the finer sort above also serves these range frames.
    def older(value: Column, seconds: int) -> Column:
        frame = W.partitionBy(*group).orderBy("t").rangeBetween(W.unboundedPreceding, -seconds * MICROS - 1)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    one = F.lit(1)
    counted = ranked.withColumns({
        "gone_1m": older(near.cast("int"), WINDOW_1M),
        "gone_5m": older(near.cast("int"), WINDOW_5M),
        "gone_fail": older(near_fail, WINDOW_5M),
    }).filter(own)

    joined = counted.join(slot_table(rows if base is None else base), group, "left")
    c5m = F.col("seen") - F.col("gone_5m")
    before_slot = F.coalesce("place_in_slot", "place_before")
    if places is not None:
        joined = salted_join(joined, places, "entity", spread="tie")
        before_slot = F.coalesce(before_slot, "known_place")
    joined = joined.withColumn("place", before_slot)
    speed = _speed()
    carried = [c for c in rows.columns if c not in
               {"slot", "fail", "dport", "dip", "nbytes", "lat", "lon"}]
    return joined.select(
        *carried,
        (F.col("seen") - F.col("gone_1m")).cast("double").alias("event_count_1m"),
        c5m.cast("double").alias("event_count_5m"),
        (F.col("n_before") + F.col("seen_own") - F.col("gone_1h")).cast("double").alias("event_count_1h"),
        ((F.col("seen_fail") - F.col("gone_fail")) / F.greatest(c5m, one)).alias("failed_auth_ratio"),
        "distinct_dest_ports", "dest_ip_fanout", "bytes_transferred",
        F.coalesce(speed, F.lit(0.0)).alias("geo_velocity_kmh"))


def _speed() -> Column:
    place = F.col("place")
    km = haversine_km(place["lat"], place["lon"], F.col("lat"), F.col("lon"))
    return F.when(F.col("lat").isNotNull() & place.isNotNull(), speed_kmh(km, F.col("us") - place["us"]))


def ordered_entity_features(rows: DataFrame, n_rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The result of `entity_features` by running sums over parts of equal size, for entities of any weight."""
    steps = F.array(
        F.struct(F.lit(ENTERED).alias("kind"), F.lit(0).alias("window"), F.col("us").alias("t")),
        *[F.struct(F.lit(LEFT).alias("kind"), F.lit(w).alias("window"), (F.col("us") + w * MICROS + 1).alias("t"))
          for w in (WINDOW_1M, WINDOW_5M, WINDOW_1H)])
    entered = F.col("kind") == ENTERED
    thin = {"entity", "tie", "fail"}
    stepped = rows.select("*", F.explode(steps).alias("_s")).select(*rows.columns, "_s.kind", "_s.window", "_s.t").select(
        *[c if c in thin else F.when(entered, F.col(c)).alias(c) for c in rows.columns], "kind", "window", "t")
    order = ["t", "kind", "tie"]
    placed = ordered_parts(stepped, ["entity"], order, -(-4 * n_rows // part_rows), "entity_steps")

    def within(value: Column, window: int) -> Column:
        return F.when(entered, value).when(F.col("window") == window, -value).otherwise(0)

    one = F.lit(1)
    place = F.when(F.col("lat").isNotNull(), F.struct("us", "tie", "lat", "lon"))
    counted = running(placed, ["entity"], order, {
        "c1m": within(one, WINDOW_1M), "c5m": within(one, WINDOW_5M), "c1h": within(one, WINDOW_1H),
        "f5m": within(F.col("fail"), WINDOW_5M)}, {"place": place}).filter(entered)
    own = placed.filter(entered)
    bucket = ["entity", "slot"]
    for c in ("dport", "dip"):
        firsts = first_of_each(own, bucket, order, c).withColumn(f"new_{c}", F.lit(1))
        counted = _equal(counted, firsts, ["_part", "_row"])
    spread = running(counted, bucket, order, {
        "ports": F.coalesce("new_dport", F.lit(0)), "ips": F.coalesce("new_dip", F.lit(0)), "bytes": F.col("nbytes")})
    carried = [c for c in rows.columns if c not in {"slot", "fail", "dport", "dip", "nbytes", "lat", "lon"}]
    return spread.select(
        *carried, F.col("c1m").cast("double").alias("event_count_1m"), F.col("c5m").cast("double").alias("event_count_5m"),
        F.col("c1h").cast("double").alias("event_count_1h"), (F.col("f5m") / F.greatest("c5m", one)).alias("failed_auth_ratio"),
        F.col("ports").cast("double").alias("distinct_dest_ports"), F.col("ips").cast("double").alias("dest_ip_fanout"),
        F.col("bytes").cast("double").alias("bytes_transferred"), F.coalesce(_speed(), F.lit(0.0)).alias("geo_velocity_kmh"))


def second_of_event() -> Column:
    """Declared non-null, so joins add no filters and equal sub-plans stay equal and are reused."""
    return F.coalesce(epoch_bucket("us", 1), F.lit(0))


def hour_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events per second, and per calendar hour."""
    per_second = rows.groupBy(second_of_event().alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    hour = F.call_function("div", F.col("sec") - F.pmod("sec", F.lit(3600)), F.lit(3600))
    per_second = per_second.withColumn("hour", F.coalesce(hour, F.lit(0)))
    hours = per_second.groupBy("hour").agg(F.sum("n").alias("c")).withColumn("hod", F.pmod("hour", F.lit(24)))
    return per_second, hours


NO_HISTORY = {"counts": [0.0] * 24, "d": 0.0}


def hour_states(hours: DataFrame, start: dict = NO_HISTORY) -> DataFrame:
    """(r0, n0, d0) at the start and the growth of every calendar hour, continuing ``start``.

    One row per calendar hour, so these small windows do not grow with the event rate.
    """
    past = W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    past_hod = W.partitionBy("hod").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    first = F.get(F.array(*[F.lit(float(x)) for x in start["counts"]]), F.col("hod").cast("int"))
    hours = hours.withColumns({
        "r0": first + F.coalesce(F.sum("c").over(past_hod), F.lit(0)).cast("double"),
        "n0": F.lit(float(sum(start["counts"]))) + F.coalesce(F.sum("c").over(past), F.lit(0)).cast("double")})
    c = F.col("c").cast("double")
    hours = hours.withColumn("grown", 2 * c * (24 * F.col("r0") - F.col("n0")) + 23 * c * c)
    return hours.withColumn("d0", F.lit(float(start["d"])) + F.coalesce(F.sum("grown").over(past), F.lit(0.0)))


def state_after(rows: DataFrame, start: dict = NO_HISTORY) -> dict:
    """The 24 counters and D after these rows: 25 numbers, whatever the data."""
    hours = hour_states(hour_totals(rows)[1], start)
    totals = hours.groupBy("hod").agg(F.sum("c").alias("c"), F.sum("grown").alias("g")).collect()
    counts, d = list(start["counts"]), float(start["d"])
    for t in totals:
        counts[t["hod"]] += float(t["c"])
        d += t["g"]
    return {"counts": counts, "d": d}


def hour_offsets(rows: DataFrame, start: dict = NO_HISTORY) -> DataFrame:
    """Per second: its rank offset inside the calendar hour and the hour's running state.

    24 counters start at 1 and grow with each event. With rank r inside the hour of day and
    global rank n, z = (24 r - n) / sqrt(D), where D = 24 sum(counter^2) - (sum counter)^2.
    Over j more events in one hour of day, D grows by 2 j (24 r0 - n0) + 23 j^2, so the state
    at the start of an hour is (r0, n0, D0), from prefix sums over the hours.
    """
    per_second, hours = hour_totals(rows)
    hours = hour_states(hours, start)
    in_hour = W.partitionBy("hour").orderBy("sec").rowsBetween(W.unboundedPreceding, -1)
    return (per_second.withColumn("j0", F.coalesce(F.sum("n").over(in_hour), F.lit(0)))
            .join(hours.select("hour", "r0", "n0", "d0"), "hour")
            .select("sec", "j0", "r0", "n0", "d0"))


def with_tod_zscore(rows: DataFrame, start: dict = NO_HISTORY, n_rows: int | None = None) -> DataFrame:
    """Add the global running time-of-day z-score, continuing the counters of ``start``."""
    timed = dealt(rows.withColumn("sec", second_of_event()), ["sec"], rows.count() if n_rows is None else n_rows)
    w = W.partitionBy("sec").orderBy("us", "tie")
    ranked = timed.withColumn("j", F.row_number().over(w)).join(hour_offsets(rows, start), "sec")
    return ranked.select(*rows.columns, _zscore().alias("tod_zscore"))


def _zscore() -> Column:
    j = (F.col("j0") + F.col("j")).cast("double")
    d = F.col("d0") + 2 * j * (24 * F.col("r0") - F.col("n0")) + 23 * j * j
    z = (24 * (F.col("r0") + j) - (F.col("n0") + j)) / F.sqrt(d)
    return F.when(d > 0, z).otherwise(0.0)


def split_tod_zscore(rows: DataFrame, busy: DataFrame, part_rows: int = PART_ROWS, n_rows: int | None = None) -> DataFrame:
    """`with_tod_zscore` where the seconds of ``busy`` (sec, n) hold too many rows for one window each."""
    timed = salted_join(rows.withColumn("sec", second_of_event()), busy.select("sec", F.lit(True).alias("_busy")), "sec", spread="tie")
    offsets = hour_offsets(rows)
    quiet = dealt(timed.filter("_busy is null").drop("_busy"), ["sec"], rows.count() if n_rows is None else n_rows)
    w = W.partitionBy("sec").orderBy("us", "tie")
    quiet = quiet.withColumn("j", F.row_number().over(w)).join(offsets, "sec")
    parts = -(-(busy.agg(F.sum("n")).first()[0] or 0) // part_rows)
    placed = ordered_parts(timed.filter("_busy").drop("_busy"), ["sec"], ["us", "tie"], parts, "busy_seconds")
    ranked = running(placed, ["sec"], ["us", "tie"], {"j": F.lit(1)})
    loud = salted_join(ranked, offsets.join(busy.select("sec"), "sec", "left_semi"), "sec", "inner", spread="tie")
    columns = [*rows.columns, _zscore().alias("tod_zscore")]
    return quiet.select(*columns).unionByName(loud.select(*columns))


def busy_keys(rows: DataFrame, split_rows: int, n_rows: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Entities (entity, n) with a slot, and seconds (sec, n), of more than ``split_rows`` rows; None where there are none.

    Both are bounded by rows / ``split_rows``. Tables that are small as a whole are not looked at.
    """
    if (rows.count() if n_rows is None else n_rows) <= split_rows:
        return None, None
    slots = rows.groupBy("entity", "slot").agg(F.count(F.lit(1)).alias("n"))
    entities = reliable(slots.groupBy("entity").agg(F.max("n").alias("most"), F.sum("n").alias("n")).filter(
        F.col("most") > split_rows).select("entity", "n"), "busy_entities")
    seconds = reliable(rows.groupBy(second_of_event().alias("sec")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > split_rows), "busy_seconds")
    return (None if entities.isEmpty() else entities), (None if seconds.isEmpty() else seconds)


def extract_features(events: DataFrame, *carry: str | Column, split_rows: int = SPLIT_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """id, entity, us, ``carry`` and the nine features of every event.

    ``split_rows``: an entity with more rows than this in one slot, and a second with more, are cut into parts of
    about ``part_rows`` rows; the result is the same.
    """
    rows = feature_rows(events, *carry)
    n_all = rows.count()
    entities, seconds = busy_keys(rows, split_rows, n_all)
    timed = (with_tod_zscore(rows, n_rows=n_all) if seconds is None
             else split_tod_zscore(rows, seconds, part_rows, n_all))
    if entities is None:
        return entity_features(timed, rows, n_rows=n_all)
    marked = salted_join(timed, entities.select("entity", F.lit(True).alias("_busy")), "entity", spread="tie")
    base = salted_join(rows, entities.select("entity", F.lit(True).alias("_busy")), "entity", spread="tie")
    quiet = entity_features(marked.filter("_busy is null").drop("_busy"), base.filter("_busy is null").drop("_busy"),
                            n_rows=n_all)
    n_rows = entities.agg(F.sum("n")).first()[0]
    return quiet.unionByName(ordered_entity_features(marked.filter("_busy").drop("_busy"), n_rows, part_rows))


def windowed_counts(events: DataFrame, window: str = "5 minutes", slide: str | None = None,
                    exact: bool = False, watermark: str | None = None) -> DataFrame:
    """Counts, distinct ports and addresses and bytes per entity and time window.

    Works on batch and streaming frames; distinct counts are approximate unless ``exact``,
    which streams do not support.
    """
    rows = events.select(
        (F.col("timestamp")).alias("ts"), entity_feature().alias("entity"),
        (F.col("event.outcome") == "failure").alias("fail"),
        F.when(F.col("destination.port") != 0, F.col("destination.port")).alias("dport"),
        F.when(F.col("destination.ip") != "", F.col("destination.ip")).alias("dip"),
        F.col("network.bytes").alias("nbytes"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return rows.groupBy("entity", F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("fail").alias("failures"),
        distinct("dport").alias("ports"), distinct("dip").alias("ips"),
        F.sum("nbytes").alias("bytes"),
    ).select("entity", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "events", "failures", "ports", "ips", "bytes")
