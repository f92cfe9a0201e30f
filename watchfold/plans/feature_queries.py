"""Feature queries over the activity table, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import (entity_features, extract_features, feature_rows, windowed_counts,
                                  with_tod_zscore)
from ..schema import FEATURES
from .driver_tables import BASE_US, security_events
from .reference_sql import EV, GEO, NINE, TOD, WINDOWED

def event_id():
    return F.col("id").cast("bigint").alias("event_id")


def all_features(spark, sf):
    f = extract_features(security_events(spark, sf))
    return f.select(event_id(), "entity", *[F.round(c, 4).alias(c) for c in FEATURES])


def features_by_parts(spark, sf):
    """All entities and seconds cut into parts, as if each were too busy for one task."""
    f = extract_features(security_events(spark, sf), split_rows=0, part_rows=5_000)
    return f.select(event_id(), "entity", *[F.round(c, 4).alias(c) for c in FEATURES])


def one_entity(spark, sf):
    """Every event is of one entity and within one second."""
    events = security_events(spark, sf)
    second = F.timestamp_micros(F.lit(BASE_US) + F.pmod(F.unix_micros("timestamp"), F.lit(1_000_000)))
    same = events.withColumns({"timestamp": second, "source": F.col("source").withField("ip", F.lit("10.1.0.7"))})
    f = extract_features(same, split_rows=500, part_rows=5_000)
    return f.select(event_id(), "entity", *[F.round(c, 4).alias(c) for c in FEATURES])


def event_counts(spark, sf):
    f = entity_features(feature_rows(security_events(spark, sf)))
    return f.select(event_id(), "entity", *[F.col(c).cast("bigint").alias(c) for c in FEATURES[:3]])


def failed_ratio(spark, sf):
    f = entity_features(feature_rows(security_events(spark, sf)))
    return f.select(event_id(), F.round("failed_auth_ratio", 6).alias("failed_auth_ratio"))


def bucket_spread(spark, sf):
    f = entity_features(feature_rows(security_events(spark, sf)))
    return f.select(event_id(), *[F.col(c).cast("bigint").alias(c) for c in FEATURES[4:7]])


def tod_zscore(spark, sf):
    z = with_tod_zscore(feature_rows(security_events(spark, sf)))
    return z.select(event_id(), F.round("tod_zscore", 4).alias("tod_zscore"))


def geo_velocity(spark, sf):
    f = entity_features(feature_rows(security_events(spark, sf)))
    return f.select(event_id(), F.round("geo_velocity_kmh", 4).alias("geo_velocity_kmh"))


def sliding_counts(spark, sf):
    w = windowed_counts(security_events(spark, sf), "5 minutes", "1 minute", exact=True)
    return w.select("entity", F.unix_micros("window_start").alias("start_us"),
                    "events", "failures", "ports", "ips", "bytes")


def tumbling_hours(spark, sf):
    w = windowed_counts(security_events(spark, sf), "1 hour", exact=True)
    return w.select("entity", F.unix_micros("window_start").alias("start_us"), "events", "failures")


QUERIES = {
    "feature_vector": all_features,
    "feature_vector_by_parts": features_by_parts,
    "feature_vector_one_entity": one_entity,
    "feature_event_counts": event_counts,
    "feature_failed_auth_ratio": failed_ratio,
    "feature_bucket_spread": bucket_spread,
    "feature_tod_zscore": tod_zscore,
    "feature_geo_velocity": geo_velocity,
    "feature_sliding_windows": sliding_counts,
    "feature_hourly_windows": tumbling_hours,
}

NINE_COLUMNS = f"""{NINE}
        SELECT event_id, entity, CAST(c1m AS DOUBLE) AS event_count_1m, CAST(c5m AS DOUBLE) AS event_count_5m,
          CAST(c1h AS DOUBLE) AS event_count_1h, round(ratio, 4) AS failed_auth_ratio,
          CAST(ports AS DOUBLE) AS distinct_dest_ports, CAST(ips AS DOUBLE) AS dest_ip_fanout,
          CAST(bytes AS DOUBLE) AS bytes_transferred, round(tod, 4) AS tod_zscore,
          round(vel, 4) AS geo_velocity_kmh FROM nine"""

# One entity, one second: every window holds all events so far, and the bucket is the whole table.
ONE_ENTITY = f"""WITH {EV},
    o AS (SELECT *, us % 1000000 AS m FROM e),
    f AS (SELECT *, row_number() OVER w AS n,
        sum((outcome = 'failure')::INT) OVER w AS fails, sum(nbytes) OVER w AS total,
        (port <> 0 AND row_number() OVER (PARTITION BY port ORDER BY m, event_id) = 1)::INT AS new_port,
        (dip <> '' AND row_number() OVER (PARTITION BY dip ORDER BY m, event_id) = 1)::INT AS new_ip
      FROM o WINDOW w AS (ORDER BY m, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    l AS (SELECT event_id, m, lat, lon, lag(m) OVER w AS pm, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
      FROM o WHERE lat IS NOT NULL WINDOW w AS (ORDER BY m, event_id)),
    v AS (SELECT event_id, 6371.0 * 2 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
        + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) * 3600 AS vel
      FROM l WHERE pm IS NOT NULL)
    SELECT event_id, '10.1.0.7' AS entity, n::DOUBLE AS event_count_1m, n::DOUBLE AS event_count_5m, n::DOUBLE AS event_count_1h,
      round(fails / n, 4) AS failed_auth_ratio,
      (sum(new_port) OVER (ORDER BY m, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS distinct_dest_ports,
      (sum(new_ip) OVER (ORDER BY m, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS dest_ip_fanout,
      total::DOUBLE AS bytes_transferred,
      round((24 * (1 + n) - (24 + n)) / sqrt(24 * (23 + pow(1 + n, 2)) - pow(24 + n, 2)), 4) AS tod_zscore,
      round(coalesce(vel, 0), 4) AS geo_velocity_kmh
    FROM f LEFT JOIN v USING (event_id)"""

ORACLES = {
    "feature_vector": NINE_COLUMNS,
    "feature_vector_by_parts": NINE_COLUMNS,
    "feature_vector_one_entity": ONE_ENTITY,
    "feature_event_counts": f"""WITH {EV}, {WINDOWED}
        SELECT event_id, entity, c1m AS event_count_1m, c5m AS event_count_5m, c1h AS event_count_1h
        FROM c JOIN e USING (event_id)""",
    "feature_failed_auth_ratio": f"""WITH {EV}, {WINDOWED}
        SELECT event_id, round(f5m / greatest(c5m, 1), 6) AS failed_auth_ratio FROM c""",
    "feature_bucket_spread": f"""WITH {EV}, {WINDOWED}
        SELECT event_id, ports AS distinct_dest_ports, ips AS dest_ip_fanout,
          CAST(bytes AS BIGINT) AS bytes_transferred FROM c""",
    "feature_tod_zscore": f"WITH {EV}, {TOD} SELECT event_id, round(tod, 4) AS tod_zscore FROM z",
    "feature_geo_velocity": f"""WITH {EV}, {GEO}
        SELECT event_id, round(coalesce(vel, 0), 4) AS geo_velocity_kmh FROM e LEFT JOIN v USING (event_id)""",
    "feature_sliding_windows": f"""WITH {EV}
        SELECT entity, start_us, count(*) AS events, count(*) FILTER (outcome = 'failure') AS failures,
          count(DISTINCT nullif(port, 0)) AS ports, count(DISTINCT nullif(dip, '')) AS ips,
          CAST(sum(nbytes) AS BIGINT) AS bytes
        FROM (SELECT *, unnest(range(5)) AS i, (us // 60000000 - i) * 60000000 AS start_us FROM e)
        GROUP BY ALL""",
    "feature_hourly_windows": f"""WITH {EV}
        SELECT entity, us // 3600000000 * 3600000000 AS start_us, count(*) AS events,
          count(*) FILTER (outcome = 'failure') AS failures FROM e GROUP BY ALL""",
}
