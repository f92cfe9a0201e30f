"""Ranks, prefix sums and joins that stay parallel when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import reliable

TASK_ROWS = 250_000


def dealt(rows: DataFrame, keys: list[str], n_rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows``, ``n_rows`` of them, shuffled by ``keys`` so that a task's share does not grow with the table.

    Spark joins small partitions up to 64 MB as shuffled, and such rows are many times as large once they are sorted.
    A table of more than ``task_rows`` for each core is dealt into a fixed number of partitions instead, which are
    not joined; at least as many as Spark's default, below which a later join would shuffle the rows again.
    """
    spark = rows.sparkSession
    if n_rows <= task_rows * spark.sparkContext.defaultParallelism:
        return rows.repartition(*keys)
    default = spark.conf.get("spark.sql.shuffle.partitions")
    least = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default) or default
    return rows.repartition(max(int(least), -(-n_rows // task_rows)), *keys)


def slotted_rank(df: DataFrame, keys: list[str], slot: Column, order: list, name: str = "rank") -> DataFrame:
    """row_number within ``keys`` by ``order``, for a slot that grows with the order.

    Rows are numbered inside (keys, slot); the start of each slot comes from a prefix sum over
    per-slot counts, so a hot key is spread over its slots.
    """
    slotted = df.withColumn("_slot", slot)
    counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    past = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           F.col("_slot").alias("_s"),
                           F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order))
    on = (F.col("_slot") == F.col("_s"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return slotted.withColumn("_j", local).join(starts, on).select(
        *df.columns, (F.col("_start") + F.col("_j")).alias(name))


def prefix_by_value(df: DataFrame, value: str, sums: list[str], bin_of: Column, descending: bool = False) -> DataFrame:
    """Running sums over rows with distinct ``value``, including the row itself.

    ``bin_of`` is a coarse bin that grows with the value. Sums over bins come from one small
    table, sums inside a bin from a window per bin, so no task sorts all values.
    """
    direction = F.desc if descending else F.asc
    binned = df.withColumn("_bin", bin_of)
    totals = binned.groupBy("_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    past = W.orderBy(direction("_bin")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_bin", *[F.coalesce(F.sum(f"_t_{c}").over(past), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = W.partitionBy("_bin").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = binned.withColumns({f"_l_{c}": F.sum(c).over(inside) for c in sums})
    return local.join(offsets, "_bin").select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in sums])


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 16,
                spread: str = "id") -> DataFrame:
    """Equi-join where one key may hold much of ``big``: its rows are spread over ``salts``
    copies of the matching ``small`` rows. ``how`` keeps or drops unmatched big rows."""
    if how not in ("inner", "left"):
        raise ValueError("only rows of the big side may be kept")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def ordered_parts(rows: DataFrame, keys: list[str], order: list[str], parts: int, name: str = "ordered") -> DataFrame:
    """``rows`` as a written table with ``_part`` and ``_row``: parts of about equal size that follow (keys, order).

    Spark samples the order, so a key, or even one instant of a key, that holds much of the data is cut into
    several parts. ``_row`` makes the order total where rows repeat.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(max(1, parts), *keys, *order, "_row")
    return reliable(placed.withColumn("_part", F.spark_partition_id()), name)


def _equal(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on columns of which ``_part`` is never null and the others may be."""
    renamed = right.select("*", *[F.col(c).alias(f"_on_{c}") for c in on]).drop(*on)
    match = F.lit(True)
    for c in on:
        match = match & (F.col(c).eqNullSafe(F.col(f"_on_{c}")))
    return left.join(renamed, match, "left").drop(*[f"_on_{c}" for c in on])


def running(placed: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
            lasts: dict[str, Column] | None = None) -> DataFrame:
    """Running values along ``order`` within ``keys`` over the parts of `ordered_parts`.

    ``sums`` include the row itself; ``lasts`` give the last non-null value before the row. A window stays within
    one part and key; what earlier parts of the key amount to is one row per (part, key), summed along the parts.
    """
    lasts = lasts or {}
    group, by = ["_part", *keys], [*order, "_row"]
    upto = W.partitionBy(*group).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*group).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns({f"_l_{n}": F.sum(c).over(upto) for n, c in sums.items()}
                               | {f"_l_{n}": F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()})
    totals = placed.groupBy(*group).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.struct(*by))).alias(f"_t_{n}") for n, c in lasts.items()])
    past = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, *[F.coalesce(F.sum(f"_t_{n}").over(past), F.lit(0)).alias(f"_o_{n}") for n in sums],
                            *[F.last(f"_t_{n}", ignorenulls=True).over(past).alias(f"_o_{n}") for n in lasts])
    joined = _equal(local, offsets, group)
    return joined.select(*placed.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
                         *[F.coalesce(f"_l_{n}", f"_o_{n}").alias(n) for n in lasts])


def first_of_each(placed: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(_part, _row) of the first row of every non-null ``value`` within ``keys``: firsts of the parts, merged along them."""
    firsts = placed.filter(F.col(value).isNotNull()).groupBy("_part", *keys, value).agg(
        F.min(F.struct(*order, "_row")).alias("_first"))
    along = W.partitionBy(*keys, value).orderBy("_part")
    return firsts.withColumn("_n", F.row_number().over(along)).filter("_n = 1").select("_part", F.col("_first._row").alias("_row"))
