"""Queue, count, histogram, trend and heat-map queries over incidents and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns a caller may filter on; anything else is ignored.
FILTER_COLUMNS = ["status", "severity"]

# Technique matrix by tactic, fixed values.
MATRIX = {
    "Initial Access": ["T1078", "T1190", "T1566", "T1133"],
    "Execution": ["T1059", "T1203", "T1106", "T1053"],
    "Persistence": ["T1098", "T1136", "T1547", "T1543"],
    "Privilege Escalation": ["T1548", "T1068", "T1134", "T1548.001"],
    "Defense Evasion": ["T1055", "T1070", "T1140", "T1036"],
    "Credential Access": ["T1110", "T1003", "T1110.001", "T1110.003"],
    "Discovery": ["T1046", "T1083", "T1057", "T1082"],
    "Lateral Movement": ["T1021", "T1021.001", "T1021.002", "T1021.004"],
    "Collection": ["T1005", "T1025", "T1074", "T1560"],
    "Exfiltration": ["T1041", "T1048", "T1052", "T1567"],
    "Impact": ["T1498", "T1486", "T1499", "T1485"],
}


def filter_incidents(incidents: DataFrame, **filters) -> DataFrame:
    for name in FILTER_COLUMNS:
        if filters.get(name) is not None:
            incidents = incidents.filter(F.col(name) == filters[name])
    return incidents


def filter_alerts(alerts: DataFrame, severity=None, status=None, entity_search=None, technique=None,
                  since=None, until=None) -> DataFrame:
    """Each of severity, status and technique may be one value or comma-separated values;
    ``entity_search`` is a case-insensitive substring of any entity field."""
    for name, value in (("severity", severity), ("status", status), ("technique", technique)):
        if value:
            alerts = alerts.filter(F.col(name).isin([v.strip() for v in value.split(",")]))
    if entity_search:
        alerts = alerts.filter(F.lower(F.to_json("entity")).contains(entity_search.lower()))
    if since is not None:
        alerts = alerts.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        alerts = alerts.filter(F.col("created_at") <= F.lit(until).cast("timestamp"))
    return alerts


def of_technique(c: Column, technique: str) -> Column:
    """The technique itself or one of its sub-techniques."""
    return (c == technique) | c.startswith(technique + ".")


def new_only(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.coalesce("status", F.lit("new")) == "new")


def not_seen(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    return alerts.join(seen.select("id"), "id", "left_anti")


def newest(df: DataFrame, limit: int, by: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(by), "id").limit(limit)


def page(df: DataFrame, number: int = 1, size: int = 50, by: str = "created_at") -> DataFrame:
    """One page, newest first, with the total number of rows on each."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(F.desc(by), "id").offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total)


def merged_feed(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    return (alerts.withColumn("kind", F.lit("alert"))
            .unionByName(incidents.withColumn("kind", F.lit("incident")), allowMissingColumns=True))


def counts_by(df: DataFrame, column: str, default: str | None = None) -> DataFrame:
    value = F.col(column) if default is None else F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(default))
    return df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def incident_kpis(incidents: DataFrame) -> DataFrame:
    resolved = F.col("status") == "resolved"
    minutes = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 60e6
    n_resolved = F.count_if(resolved)
    return incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if((F.col("severity") == "critical") & (F.col("status") == "open")).alias("critical_open"),
        n_resolved.alias("resolved"),
        (F.coalesce(F.sum(F.when(resolved, minutes)), F.lit(0.0)) / F.greatest(n_resolved, F.lit(1)))
        .alias("avg_resolution_minutes"))


def alert_kpis(alerts: DataFrame) -> DataFrame:
    """Zero and missing scores do not enter the average."""
    score = F.col("anomaly_score")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.coalesce("status", F.lit("new")) == "new").alias("new_alerts"),
        F.coalesce(F.avg(F.when(score != 0, score)), F.lit(0.0)).alias("avg_score"))


def kpis(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row over all incidents and alerts: one aggregate per table, that of the alerts as a one-row subquery."""
    left, right = incident_kpis(incidents), alert_kpis(alerts)
    alert_row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_a", alert_row).select(*left.columns, "_a.*")


def score_histogram(alerts: DataFrame, bins: int = 20, score: str = "anomaly_score") -> DataFrame:
    """Equal bins over [min, max] with the mean; empty bins are zero."""
    known = alerts.filter(F.col(score).isNotNull())
    stats = known.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean")))
    s = stats.scalar()
    width = (s["hi"] - s["lo"]) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(score) - s["lo"]) / width), F.lit(bins - 1))).otherwise(0)
    counts = known.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = alerts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (s["lo"] + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"), s["mean"].alias("mean"))


def fixed_histogram(alerts: DataFrame, edges: list[float], score: str = "anomaly_score") -> DataFrame:
    """Counts per [edge, next edge); the last edge is a bin of its own."""
    known = alerts.filter(F.col(score).isNotNull())
    at = F.lit(None).cast("double")
    for edge in edges:
        at = F.when(F.col(score) >= edge, F.lit(edge)).otherwise(at)
    counts = known.groupBy(at.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
    spine = alerts.sparkSession.createDataFrame([(e,) for e in edges], "bin_start double")
    return spine.join(F.broadcast(counts), "bin_start", "left").select("bin_start", F.coalesce("n", F.lit(0)).alias("n"))


def per_day(alerts: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Rows per day for the last ``days`` days up to ``as_of`` (a Column or value), zero filled."""
    last = F.to_date(as_of if isinstance(as_of, Column) else F.lit(as_of))
    spine = alerts.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    # On the column itself, so that a scan can skip files by it.
    recent = alerts.filter((F.col("created_at") >= F.date_sub(last, days - 1).cast("timestamp"))
                           & (F.col("created_at") < F.date_add(last, 1).cast("timestamp")))
    counts = recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def per_minute(events: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    since = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return (events.filter((F.col("timestamp") > since) & (F.col("timestamp") <= as_of))
            .groupBy(F.date_trunc("minute", "timestamp").alias("minute")).agg(F.count(F.lit(1)).alias("n")))


def parent_of(technique: Column) -> Column:
    return F.split_part(technique, F.lit("."), F.lit(1))


def technique_heat(incidents: DataFrame, roll_up: bool = True, technique: str = "technique") -> DataFrame:
    """Incidents per technique; with ``roll_up`` a sub-technique also counts for its parent.

    Counted per technique before the roll-up, so the explode works on distinct techniques.
    """
    known = incidents.filter(F.coalesce(F.col(technique), F.lit("")) != "")
    counts = known.groupBy(F.col(technique).alias("technique")).agg(F.count(F.lit(1)).alias("n"))
    if not roll_up:
        return counts
    targets = F.array_distinct(F.array("technique", parent_of(F.col("technique"))))
    return counts.select(F.explode(targets).alias("technique"), "n").groupBy("technique").agg(F.sum("n").alias("n"))


def parent_counts(incidents: DataFrame) -> DataFrame:
    return (incidents.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(parent_of(F.col("technique")).alias("technique")).agg(F.sum("n").alias("n")))


def matrix_frame(spark) -> DataFrame:
    rows = [(i, t, j, x) for i, (t, xs) in enumerate(MATRIX.items()) for j, x in enumerate(xs)]
    return spark.createDataFrame(rows, "tactic_order int, tactic string, cell_order int, technique string")


def matrix_heat(incidents: DataFrame, rule_techniques: list[str]) -> DataFrame:
    """Every matrix cell with its count (itself or a sub-technique) and whether a rule covers it."""
    cells = matrix_frame(incidents.sparkSession)
    counts = technique_heat(incidents)
    covered = F.lit(False)
    for parent in sorted({t.split(".")[0] for t in rule_techniques if t}):
        covered = covered | F.col("technique").startswith(parent)
    return cells.join(counts, "technique", "left").select(
        "tactic", "technique", F.coalesce("n", F.lit(0)).alias("n"), covered.alias("has_rule"))


def heat_level(n: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "low").when(n <= 3, "medium").otherwise("high")


def heat_level_web(n: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "low").when(n == 2, "medium").otherwise("high")


def score_colour(score: Column) -> Column:
    return (F.when(score >= 0.75, "#ef4444").when(score >= 0.50, "#f97316")
            .when(score >= 0.30, "#eab308").otherwise("#22c55e"))


def navigator_layer(incidents: DataFrame) -> DataFrame:
    heat = technique_heat(incidents, roll_up=False)
    return heat.select(F.col("technique").alias("technique_id"), F.col("n").alias("score"),
                       heat_level(F.col("n")).alias("level"))


def age_label(created: Column, as_of: Column) -> Column:
    s = F.unix_micros(as_of) / 1e6 - F.unix_micros(created) / 1e6

    def text(divisor: int, unit: str) -> Column:
        return F.concat((s / divisor).cast("bigint").cast("string"), F.lit(unit + " ago"))

    return (F.when(created.isNull(), F.lit("—")).when(s < 60, text(1, "s")).when(s < 3600, text(60, "m"))
            .when(s < 86400, text(3600, "h")).otherwise(text(86400, "d")))


def cost_per_day(calls: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    if as_of is not None:
        calls = calls.filter((F.col("called_at") > as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("called_at") <= as_of))
    return calls.groupBy(F.to_date("called_at").alias("day")).agg(F.sum("cost_usd").alias("cost"))


def entity_registry(events: DataFrame) -> DataFrame:
    """First and last sighting of every host, user and address.

    Sightings are reduced per (type, value) before the shuffle.
    """
    def item(kind: str, path: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.col(path).alias("value"))

    seen = events.select("timestamp", F.explode(F.array(
        item("ip", "source.ip"), item("host", "host.name"), item("user", "user.name"))).alias("e"))
    return (seen.select("timestamp", "e.type", "e.value").filter("value is not null and value <> ''")
            .groupBy("type", "value").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")))
