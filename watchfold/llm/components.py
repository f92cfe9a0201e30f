"""Connected components of an edge table, by alternating star steps on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfold.session import reliable


def _stars(edges: DataFrame) -> bool:
    """Whether every node of (hi, lo) has one smaller neighbour or none, and one with a smaller neighbour no larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
                                          F.struct(F.col("lo").alias("u"), F.lit(None).cast(edges.schema["lo"].dataType).alias("v")))).alias("e"))
    met = ends.groupBy("e.u").agg(F.min("e.v").alias("x"), F.max("e.v").alias("y"), F.max(F.col("e.v").isNull()).alias("low"))
    return not met.agg(F.coalesce(F.bool_or((F.col("x") != F.col("y")) | (F.col("x").isNotNull() & F.col("low"))), F.lit(False))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round links every node to the smallest one it knows (large star, then small star), so paths shorten
    fast and a hub of very many neighbours costs one row per neighbour: minima combine before the shuffle and
    nothing gathers a neighbour list. A round ends in a written table, the last round in stars only. Loops and repeated edges do no
    harm; edges with a null end are ignored; no edges give no rows.
    """
    now = reliable(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                   .distinct(), "edges")
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # One row per edge, with repeated ones: telling them apart here would cost a shuffle more than it saves.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = F.when(F.col("lo") != F.col("m"), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        small = large.join(lowest, "hi").select(F.explode(F.array(moved, F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        now = reliable(small.filter("e is not null").select("e.hi", "e.lo").distinct(), "edges")
        if _stars(now):
            break
    roots = now.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
