"""Address range lookup (country, network) for source addresses of both families.

Ranges may nest or overlap. They are flattened once into disjoint segments, each with the narrowest range that
covers it: range bounds are cut into parts along the address order, a range is sent to every part that it reaches,
and each part is swept on its own. Looking up is then one predecessor search: addresses and segment bounds are
cut into parts along the same order, and every address takes the last bound before it, from its own part or an
earlier one. No address meets more than one range, whatever their widths.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.network import address_key, network_bounds
from .events import evaluated_once
from .ranks import ordered_parts, running, salted_join
from ..session import reliable

# Order of what meets at one address: ranges begin, addresses are looked up, ranges end.
BEGINS, ASKED, ENDS = 0, 1, 2
PART_ROWS = 100_000


def ranges_of_networks(networks: DataFrame, column: str = "network") -> DataFrame:
    """``networks`` with start_ip and end_ip in place of a column of CIDR networks; host bits are ignored, other texts dropped."""
    bounds = evaluated_once(networks.withColumnRenamed(column, "_network"), _b=network_bounds(F.col("_network")))
    return bounds.filter(F.col("_b").isNotNull()).select(
        *[c for c in networks.columns if c != column], F.col("_b.start").alias("start_ip"), F.col("_b.end").alias("end_ip"))


def _as_key(df: DataFrame, column: str) -> Column:
    """Keys as they are, texts as addresses, numbers as IPv4 addresses."""
    kind = df.schema[column].dataType.typeName()
    if kind == "binary":
        return F.col(column)
    if kind == "string":
        return address_key(F.col(column))
    number = F.col(column).cast("bigint")
    return F.when(number.between(0, 2**32 - 1), F.unhex(F.concat(F.lit("04" + "0" * 24), F.lpad(F.hex(number), 8, "0"))))


def _sweep(table: pa.Table) -> pa.Table:
    """Bounds of the disjoint segments of one part: (key, side, range) with a null range where none covers."""
    low, low_side = table.column("low")[0].as_py(), table.column("low_side")[0].as_py()
    high, high_side = table.column("high")[0].as_py(), table.column("high_side")[0].as_py()
    begins, spans = [], {}
    for number, start, end in zip(*[table.column(c).to_pylist() for c in ("range", "start_ip", "end_ip")]):
        if number is None:
            continue
        first = (start, BEGINS)
        if low is not None:
            first = max(first, (low, low_side))
        begins.append((first, number))
        spans[number] = (int.from_bytes(end, "big") - int.from_bytes(start, "big"), start, number, (end, ENDS))
    stops = [s[3] for s in spans.values() if high is None or s[3] < (high, high_side)]
    points = sorted({p for p, _ in begins} | set(stops) | ({(low, low_side)} if low is not None else set()))
    begins.sort()
    active, at, out, last = [], 0, [], -1
    for point in points:
        while at < len(begins) and begins[at][0] <= point:
            heapq.heappush(active, spans[begins[at][1]])
            at += 1
        while active and active[0][3] <= point:
            heapq.heappop(active)
        now = active[0][2] if active else None
        if now != last:
            out.append((*point, now))
            last = now
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.table({"key": pa.array(columns[0], pa.binary()), "side": pa.array(columns[1], pa.int32()), "range": pa.array(columns[2], pa.int64())})


def flatten_ranges(ranges: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Segments (key, side, range) that cover the address order without overlap, and the numbered ranges.

    A segment begins at its (key, side) and reaches to the next one; ``range`` is the narrowest range there (the
    lower start, then the lower number, among equal widths), or null. Ranges that end before they start, or whose
    bounds are not addresses of one family, cover nothing.
    """
    keyed = evaluated_once(ranges, _start=_as_key(ranges, "start_ip"), _end=_as_key(ranges, "end_ip")).filter(
        (F.col("_start") <= F.col("_end")) & (F.substring("_start", 1, 1) == F.substring("_end", 1, 1)))
    payload = [c for c in ranges.columns if c not in ("start_ip", "end_ip")]
    kept = reliable(keyed.select(F.col("_start").alias("start_ip"), F.col("_end").alias("end_ip"), *payload,
                                 F.monotonically_increasing_id().alias("range")), "ranges")
    bounds = kept.select("range", F.explode(F.array(
        F.struct(F.col("start_ip").alias("key"), F.lit(BEGINS).alias("side")),
        F.struct(F.col("end_ip").alias("key"), F.lit(ENDS).alias("side")))).alias("_b")).select("range", "_b.*")
    placed = ordered_parts(bounds, [], ["key", "side"], -(-2 * kept.count() // part_rows), "range_bounds")
    # One row per part: where it begins, and where the next one does.
    along = W.orderBy("_part")
    parts = placed.groupBy("_part").agg(F.min(F.struct("key", "side")).alias("low")).select(
        "_part", (F.row_number().over(along) - 1).alias("at"), F.lead("low").over(along).alias("high"), "low").withColumn(
        "low", F.when(F.col("at") > 0, F.col("low")))
    parts = reliable(parts, "range_parts")
    reach = placed.join(parts.select("_part", "at"), "_part").groupBy("range").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    sent = reach.select("range", F.explode(F.sequence("first", "last")).alias("at")).join(kept.select("range", "start_ip", "end_ip"), "range")
    filled = parts.join(sent, "at", "left").select(
        "at", "range", "start_ip", "end_ip", F.col("low.key").alias("low"), F.col("low.side").alias("low_side"),
        F.col("high.key").alias("high"), F.col("high.side").alias("high_side"))
    return filled.groupBy("at").applyInArrow(_sweep, "key binary, side int, range long"), kept


def lookup_addresses(addresses: DataFrame, ranges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Each address with the narrowest range that holds it; addresses outside all ranges have no row.

    ``addresses`` has a distinct ``ip`` as IPv4 or IPv6 text (an IPv4 address inside IPv6 counts as IPv4, a zone is
    ignored, other texts are in no range). ``ranges`` has start_ip and end_ip, inclusive, as texts, as keys of
    `address_key` or as IPv4 numbers, and any payload.
    """
    payload = [c for c in ranges.columns if c not in ("start_ip", "end_ip")]
    segments, numbered = flatten_ranges(ranges, part_rows)
    asked = evaluated_once(addresses.select("ip"), key=address_key(F.col("ip"))).filter(F.col("key").isNotNull())
    both = segments.select("key", "side", F.struct("range").alias("segment"), F.lit(None).cast("string").alias("ip")).unionByName(
        asked.select("key", F.lit(ASKED).alias("side"), F.lit(None).cast("struct<range: bigint>").alias("segment"), "ip"))
    both = reliable(both, "looked_up")
    placed = ordered_parts(both, [], ["key", "side"], -(-both.count() // part_rows), "address_order")
    found = running(placed, [], ["key", "side"], {}, {"covering": F.col("segment")}).filter(F.col("side") == ASKED)
    hits = found.select("ip", F.col("covering.range").alias("range")).filter(F.col("range").isNotNull())
    return salted_join(hits, numbered.drop("start_ip", "end_ip"), "range", "inner", spread="ip").select("ip", *payload)


def locate(rows: DataFrame, ranges: DataFrame, ip: str = "ip", spread: str = "id", part_rows: int = PART_ROWS) -> DataFrame:
    """Best-effort enrichment: distinct addresses are looked up once, then joined back with salt,
    because one address may hold much of the rows."""
    found = lookup_addresses(rows.select(F.col(ip).alias("ip")).distinct(), ranges, part_rows).withColumnRenamed("ip", ip)
    return salted_join(rows, found, ip, "left", spread=spread)
