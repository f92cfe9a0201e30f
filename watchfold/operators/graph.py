"""Attack graph tables and playbook choice.

Edges run from every attacker to every victim and pivot, and from every pivot to every victim of
an incident. Over all incidents the graph is kept as edge sides, which is linear in the entities;
pairs are formed only for the one incident that is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_label
from .normalize_cloud import lookup
from .ranks import ordered_parts, running

# Role -> node style, fixed values.
ROLE_STYLES = {
    "attacker": "fill:#ef4444,color:#fff,stroke:#dc2626",
    "victim": "fill:#f97316,color:#fff,stroke:#ea580c",
    "pivot": "fill:#eab308,color:#000,stroke:#ca8a04",
    "context": "fill:#3b82f6,color:#fff,stroke:#2563eb",
}
# Technique (first five characters) -> playbook, fixed values.
PLAYBOOKS = {
    "T1110": "brute_force.yml", "T1021": "lateral_movement.yml", "T1498": "ddos_mitigation.yml",
    "T1548": "privesc_account_suspend.yml", "T1041": "data_exfil_egress_block.yml",
    "T1046": "port_scan_block.yml", "T1055": "process_injection_isolation.yml",
    "T1078": "impossible_travel_lockout.yml", "T1059": "scripting_interpreter_block.yml",
}
GENERIC_PLAYBOOK = "generic_block.yml"

# Edge class -> source role, destination role, label (None: technique and tactic).
EDGE_CLASSES = {
    "attack": ("attacker", "victim", None),
    "pivot": ("attacker", "pivot", "pivot"),
    "lateral": ("pivot", "victim", "lateral move"),
}


def playbook(technique: Column) -> Column:
    table = {k: (v,) for k, v in PLAYBOOKS.items()}
    return F.coalesce(lookup(table, F.substring(technique, 1, 5), 0), F.lit(GENERIC_PLAYBOOK))


def node_label() -> Column:
    """The first two of address, host, user and country, else the role."""
    def part(c: str, left: str = "", right: str = "") -> Column:
        return F.when(F.col(c) != "", F.concat(F.lit(left), F.col(c), F.lit(right)))

    parts = F.array_compact(F.array(part("ip"), part("host"), part("user", "user:"), part("geo_country", "(", ")")))
    shown = F.when(F.size(parts) == 0, F.coalesce("role", F.lit("context"))).otherwise(
        F.array_join(F.slice(parts, 1, 2), r"\n"))
    return sanitize_label(shown)


def graph_nodes(entities: DataFrame) -> DataFrame:
    styles = {k: (v,) for k, v in ROLE_STYLES.items()}
    return entities.select("incident_id", "position", "role", node_label().alias("label"),
                           F.coalesce(lookup(styles, F.col("role"), 0), F.lit(ROLE_STYLES["context"])).alias("style"))


def edge_sides(entities: DataFrame) -> DataFrame:
    """One row per (entity, edge class, side) it takes part in."""
    sides = []
    for name, (src, dst, _) in EDGE_CLASSES.items():
        for side, role in (("from", src), ("to", dst)):
            sides.append(F.when(F.col("role") == role, F.struct(F.lit(name).alias("edge"), F.lit(side).alias("side"))))
    return entities.select("incident_id", "position", F.explode(F.array_compact(F.array(*sides))).alias("s")).select(
        "incident_id", "position", "s.edge", "s.side")


def edge_counts(entities: DataFrame) -> DataFrame:
    """Edges per incident and class, without forming them."""
    per = edge_sides(entities).groupBy("incident_id", "edge").agg(
        F.count_if(F.col("side") == "from").alias("sources"), F.count_if(F.col("side") == "to").alias("targets"))
    return per.withColumn("edges", F.col("sources") * F.col("targets")).filter("edges > 0")


def edge_page(entities: DataFrame, first: int, size: int, parts: int = 8) -> DataFrame:
    """(number, incident_id, edge, from_position, to_position): edges ``first`` to ``first + size - 1`` of all incidents.

    Edges are numbered by incident, class, source and target position, without being formed: running sums of the
    edge counts find the at most ``size`` groups of the page, and the number inside a group of s x t edges gives the
    ranks of its two ends (quotient and remainder by t). Ranks are running counts over parts of equal size,
    so one incident may hold most entities.
    """
    group = ["incident_id", "edge"]
    counted = ordered_parts(edge_counts(entities), [], group, parts, "edge_counts")
    total = running(counted, [], group, {"upto": F.col("edges")}).withColumn("start", F.col("upto") - F.col("edges"))
    last = first + size
    hit = total.filter((F.col("start") < last) & (F.col("upto") > first))
    numbers = F.sequence(F.greatest("start", F.lit(first)), F.least("upto", F.lit(last)) - 1)
    wanted = hit.select(*group, "targets", "start", F.explode(numbers).alias("number")).withColumn("k", F.col("number") - F.col("start"))
    wanted = wanted.select(*group, "number", F.expr("k div targets + 1").alias("from_rank"), (F.col("k") % F.col("targets") + 1).alias("to_rank"))
    sides = edge_sides(entities).join(hit.select(*group), group, "left_semi")
    ranked = running(ordered_parts(sides, [*group, "side"], ["position"], parts, "edge_sides"), [*group, "side"], ["position"],
                     {"rank": F.lit(1)})
    for side in ("from", "to"):
        ends = ranked.filter(F.col("side") == side).select(*group, F.col("rank").alias(f"{side}_rank"), F.col("position").alias(f"{side}_position"))
        wanted = wanted.join(ends, [*group, f"{side}_rank"])
    return wanted.select("number", *group, "from_position", "to_position")


def incident_edges(entities: DataFrame, incident_id: str, technique: str = "Unknown", tactic: str = "Unknown") -> DataFrame:
    """The edges of one incident, for drawing it."""
    nodes = graph_nodes(entities.filter(F.col("incident_id") == incident_id))
    sides = edge_sides(entities.filter(F.col("incident_id") == incident_id)).join(nodes, ["incident_id", "position"])
    left = sides.filter("side = 'from'").select("edge", F.col("position").alias("from_position"), F.col("label").alias("from_label"))
    right = sides.filter("side = 'to'").select("edge", F.col("position").alias("to_position"), F.col("label").alias("to_label"))
    labels = {k: (v[2] or f"{technique} ({tactic})",) for k, v in EDGE_CLASSES.items()}
    return left.join(right, "edge").withColumn("label", sanitize_label(lookup(labels, F.col("edge"), 0)))
