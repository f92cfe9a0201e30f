"""Exact k nearest binary codes by incremental multi-index hashing.

A code (a long of 64 bits, or a struct of several such words) is cut into segments of about log2(n) bits; an index lists the distinct codes by segment and
segment value, in blocks of bounded length. In round r a query asks its segments for the values at exactly r
flipped bits. After round r all codes within ``segments * (r + 1) - 1`` bits have been met (pigeonhole), so a query
is finished once its kth verified distance is not above that; the others go on with radius r + 1. Queries that
are open when a round would ask for more segment values than there are codes meet the blocks of all codes instead.

Once a query has k verified neighbours, the kth distance bounds it. Codes beyond the bound are dropped inside
their block, and round r asks only the first ``bound - segments * r + 1`` segments: a code all of whose segments
differ by r or more, and those segments by more than r, lies beyond the bound.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchfold.session import reliable

WORD = 64
SCAN_PARTS = 64  # shares of all codes that the queries of a last scan meet
BLOCK_BITS = 8  # a block of the index holds at most 2^8 codes


def sign_code(vector: str, bits: int = WORD) -> Column:
    """Bit i is set where component i is positive; null for a vector that is null, empty, longer than ``bits`` or
    holds a null or non-finite component. Codes of more than 64 bits are structs of 64-bit words; components that
    a shorter vector lacks count as not positive."""
    v = F.col(vector)
    usable = (F.size(v).between(1, bits)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def word(part: Column) -> Column:
        flags = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    if bits <= WORD:
        return F.when(usable, word(v))
    return F.when(usable, F.struct(*[word(F.slice(v, at + 1, WORD)).alias(f"w{at // WORD}") for at in range(0, bits, WORD)]))


def longest(rows: DataFrame, vector: str) -> int:
    """Components of the longest vector, at least 1."""
    return max(rows.agg(F.max(F.size(vector))).first()[0] or 1, 1)


def _segments(n: int, words: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of the segments for ``n`` distinct codes."""
    wide = min(max(int(math.log2(max(n, 2))), 4), 32)
    count = -(-WORD // wide)
    edges = [i * WORD // count for i in range(count + 1)]
    return [(word, a, b - a) for word in range(words) for a, b in zip(edges, edges[1:])]


def _part(word: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def nearest(queries: DataFrame, base: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row of ``queries`` (id, code) the ``k`` rows of ``base``
    (id, code) at the smallest Hamming distance, smaller ids first on ties, without the row of its own id.

    Exact for any data. Equal codes are one entry of the index with their ``k + 1`` smallest ids, and equal
    queries are asked once, so very frequent codes cost one candidate. Codes are longs or structs of longs. Rows without id or code are neither
    asked nor found; repeated rows of ``base`` count once; fewer than ``k`` other rows give fewer ranks.
    """
    most = k + 1
    rows = base.select("id", "code").filter("id is not null and code is not null").distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= most)
    codes = reliable(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = reliable(queries.select("id", "code").filter("id is not null and code is not null").distinct(), "queries")
    count, kind = codes.count(), codes.schema["code"].dataType
    names = kind.names if isinstance(kind, StructType) else []

    def words(code: Column) -> list[Column]:
        return [code[n] for n in names] or [code]

    def apart(one: Column, two: Column) -> list[Column]:
        return [a.bitwiseXOR(b) for a, b in zip(words(one), words(two))]

    def distance(one: Column, two: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.bit_count(x) for x in apart(one, two)])

    parts = _segments(count, len(names) or 1)
    which = F.array(*[F.struct(F.lit(j).alias("j"), _part(words(F.col("code"))[n], s, w).alias("value")) for j, (n, s, w) in enumerate(parts)])
    listed = codes.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), F.explode(which).alias("at"))
    # Ranges over the code as well, so that a very common segment value is spread over tasks and blocks.
    placed = (listed.select("at.j", "at.value", "code", "least", "n").repartitionByRange("j", "value", "code")
              .sortWithinPartitions("j", "value", "code")
              .withColumn("block", F.call_function("shiftright", F.monotonically_increasing_id(), F.lit(BLOCK_BITS))))
    index = reliable(placed.groupBy("j", "value", "block").agg(F.collect_list(F.struct("code", "least", "n")).alias("codes"))
                     .select("j", "value", "codes"), "index")
    active = asked.select(F.col("code").alias("q"), F.lit(WORD * (len(names) or 1)).alias("bound")).distinct()
    state = codes.sparkSession.createDataFrame([], f"q {kind.simpleString()}, code {kind.simpleString()}, d int, least long, n int")
    finished, radius = [], 0
    top = Window.partitionBy("q").orderBy("d", "least")

    def scanned(open_: DataFrame) -> DataFrame:
        """The nearest codes of the open queries among all codes, which come in blocks, each met by every query once."""
        share = F.explode(F.sequence(F.lit(0), F.lit(SCAN_PARTS - 1))).alias("part")
        blocks = index.filter("j = 0").select(F.pmod(F.xxhash64("codes"), F.lit(SCAN_PARTS)).cast("int").alias("part"), "codes")
        close = F.filter("codes", lambda c: distance(F.col("q"), c["code"]) <= F.col("bound"))
        met = open_.select("q", "bound", share).hint("merge").join(blocks, "part").select("q", F.explode(close).alias("found"))
        found = met.select("q", "found.code", distance(F.col("q"), F.col("found.code")).alias("d"), "found.least")
        return found.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most).select("q", "code", "d")
    while True:
        masks = {w: json.dumps([sum(1 << b for b in bits) for bits in combinations(range(w), radius)]) for w in {w for _, _, w in parts}}
        probes = None
        for j, (n, s, w) in enumerate(parts):
            mask = F.explode(F.from_json(F.lit(masks[w]), "array<long>"))
            one = (active.filter(F.col("bound") >= len(parts) * radius + j).select("q", "bound", mask.alias("mask"))
                   .select("q", "bound", F.lit(j).alias("j"), _part(words(F.col("q"))[n], s, w).bitwiseXOR(F.col("mask")).alias("value")))
            probes = one if probes is None else probes.union(one)

        def fresh(found: Column) -> Column:
            """Within the bound and met for the first time: no segment is closer than the radius, none before j as close."""
            other = apart(F.col("q"), found["code"])
            flips = [F.bit_count(_part(other[n], s, w)) for n, s, w in parts]
            new = (distance(F.col("q"), found["code"]) <= F.col("bound")) & (F.array_min(F.array(*flips)) == radius)
            for j, flip in enumerate(flips):
                new = new & ((F.col("j") <= j) | (flip > radius))
            return new

        # Spark takes exploded rows for as small as their source; a broadcast of them would have no bound.
        near = probes.hint("merge").join(index, ["j", "value"]).select("q", F.filter("codes", fresh).alias("codes"))
        met = near.select("q", F.explode("codes").alias("found")).select(
            "q", "found.code", distance(F.col("q"), F.col("found.code")).alias("d"), "found.least", "found.n")
        ordered = state.union(met).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most)
        state = reliable(ordered.withColumn("sum", F.sum("n").over(top.rowsBetween(Window.unboundedPreceding, 0))), "nearest")
        reach = len(parts) * (radius + 1) - 1
        last = radius >= max(w for _, _, w in parts)
        done = state.filter(F.lit(last) | ((F.col("sum") >= most) & (F.col("d") <= reach))).select("q").distinct()
        finished.append(state.join(done, "q", "left_semi").select("q", "code", "d"))
        bounds = state.filter(F.col("sum") >= most).groupBy("q").agg(F.min("d").alias("least_bound"))
        active = reliable(active.join(done, "q", "left_anti").join(bounds, "q", "left")
                          .select("q", F.coalesce("least_bound", "bound").alias("bound")), "active")
        if last or active.isEmpty():
            break
        radius += 1
        if sum(math.comb(w, radius) for _, _, w in parts) > count:
            finished.append(scanned(active))
            break
        state = state.join(done, "q", "left_anti").select("q", "code", "d", "least", "n")
    found = finished[0]
    for part in finished[1:]:
        found = found.union(part)
    ids = found.join(codes, "code").select(F.col("q"), "d", F.explode("ids").alias("neighbour_id"))
    answers = asked.withColumnsRenamed({"id": "query_id", "code": "q"}).join(ids, "q").filter("query_id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbour_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "neighbour_id", F.col("d").alias("distance"))
