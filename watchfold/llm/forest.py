"""Near-duplicate vectors by a random-projection tree forest.

Every tree splits recursively at the median of a random projection; rows near a split spill into both sides, by
``slack`` of the typical projected distance of a pair at the threshold. Thresholds are fitted on at most about ``SAMPLE`` rows per node, all rows are routed. Nodes above
``leaf`` rows are split again until they are small, or until a split would spill more than ``SPILLED`` of its
rows, as in a group of near copies; such leaves are compared in blocks. Inside a leaf all cosines are computed
exactly. A pair that meets in several leaves is counted in the one of smallest id only, so link counts are
summed without writing the pairs, and a leaf passes on a star per local component instead of its links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfold.llm import words as W
from watchfold.llm.components import components
from watchfold.operators.ranks import salted_join
from watchfold.session import reliable

SAMPLE = 1024
SPILLED = 0.2
DEPTH = 6
BLOCK = 1024
ENTRY = "rep long, label int, copies long, embedding array<float>, tree int, level int, node long, done boolean"


def directions(tree: int, level: int, count: int, dim: int) -> np.ndarray:
    """``count`` unit projections of consecutive levels of a tree, the same on every machine."""
    rows = [np.random.default_rng([tree, level + i, dim, 97]).standard_normal(dim) for i in range(count)]
    return np.array([r / np.linalg.norm(r) for r in rows])


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_node(sample: np.ndarray, size: int, leaf: int, margin: float) -> np.ndarray:
    """Thresholds of a subtree in heap order from projections (rows x DEPTH): NaN ends a branch, inf ends it for good."""
    out = np.full(2 ** DEPTH - 1, np.nan)
    rows = {0: np.arange(len(sample))}
    share = size / max(len(sample), 1)
    for pos in range(len(out)):
        at = rows.pop(pos, None)
        if at is None or len(at) * share <= leaf or len(at) < 8:
            continue
        p = sample[at, (pos + 1).bit_length() - 1]
        cut = np.median(p)
        left, right = at[p <= cut + margin], at[p > cut - margin]
        if len(left) + len(right) > (1 + SPILLED) * len(at):
            out[pos] = np.inf
            continue
        out[pos] = cut
        rows[2 * pos + 1], rows[2 * pos + 2] = left, right
    return out


def _fit(leaf: int, reach: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        x = unit(group["embedding"].tolist())
        p = x @ directions(int(first["tree"]), int(first["level"]), DEPTH, x.shape[1]).T
        return pd.DataFrame({"node": [first["node"]], "cuts": [fit_node(p, int(first["size"]), leaf, reach / np.sqrt(x.shape[1]))]})
    return run


def _route(reach: float):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(i) for i, n in enumerate(names)}
            tree, level, node = (col[n].to_numpy(zero_copy_only=False) for n in ("tree", "level", "node"))
            dim = pa.compute.list_value_length(col["embedding"]).to_numpy(zero_copy_only=False)
            cuts = col["cuts"].flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            flat = col["embedding"].flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(dim)])
            groups = pd.DataFrame({"t": tree, "l": level, "d": dim}).groupby(["t", "l", "d"]).indices
            took, where, steps, ends = [], [], [], []
            for (t, lv, d), rows in groups.items():
                x = unit(flat[(at[rows][:, None] + np.arange(d))].tolist())
                p = x @ directions(int(t), int(lv), DEPTH, int(d)).T
                margin = reach / np.sqrt(d)
                now, pos = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
                for depth in range(DEPTH + 1):
                    cut = cuts[rows[now], pos] if depth < DEPTH else np.full(len(now), np.nan)
                    stop = ~np.isfinite(cut)
                    took.append(rows[now[stop]])
                    where.append(pos[stop])
                    steps.append(np.full(stop.sum(), depth))
                    ends.append(np.isinf(cut[stop]))
                    now, pos, cut = now[~stop], pos[~stop], cut[~stop]
                    if not len(now):
                        break
                    q = p[now, depth]
                    left, right = q <= cut + margin, q > cut - margin
                    now, pos = np.concatenate([now[left], now[right]]), np.concatenate([2 * pos[left] + 1, 2 * pos[right] + 2])
            took, where = np.concatenate(took), np.concatenate(where)
            child = W.mix(node[took].view(np.uint64) * np.uint64(W.BASE) + where.astype(np.uint64)).view(np.int64)
            pick = pa.array(took)
            yield pa.RecordBatch.from_arrays(
                [col[n].take(pick) for n in ("rep", "label", "copies", "embedding", "tree")]
                + [pa.array((level[took] + np.concatenate(steps)).astype(np.int32)), pa.array(child), pa.array(np.concatenate(ends))],
                ["rep", "label", "copies", "embedding", "tree", "level", "node", "done"])
    return run


def grow(vectors: DataFrame, trees: int, leaf: int, reach: float) -> DataFrame:
    """Leaf entries (see ENTRY) of all ``vectors`` (rep, label, copies, embedding) in all trees."""
    spark = vectors.sparkSession
    entries = (vectors.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
               .withColumn("level", F.lit(0))
               .withColumn("node", F.xxhash64("label", F.size("embedding"), "tree")).withColumn("done", F.lit(False)))
    open_ = reliable(entries.select("rep", "label", "copies", "embedding", "tree", "level", "node", "done"), "tree")
    leaves = spark.createDataFrame([], ENTRY)
    while True:
        sizes = reliable(open_.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("done").alias("over")), "sizes")
        big = sizes.filter((F.col("size") > 2 * leaf) & ~F.col("over")).select("node", "size")
        leaves = leaves.union(open_.join(big.select("node"), "node", "left_anti").select(leaves.columns))
        if big.isEmpty():
            return leaves
        drawn = salted_join(open_, big, "node", "inner", spread="rep").filter(
            F.pmod(F.xxhash64("rep", "node", F.lit(5)), F.lit(1 << 30)) * F.col("size") < F.lit(SAMPLE << 30))
        cuts = reliable(drawn.groupBy("node").applyInPandas(_fit(leaf, reach), "node long, cuts array<double>"), "cuts")
        routed = salted_join(open_, cuts, "node", "inner", spread="rep")
        open_ = reliable(routed.mapInArrow(_route(reach), ENTRY), "tree")


def _linked(least: float):
    """Compare two blocks of a leaf (or one with itself)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node = int(group["node"].iloc[0])
        one = group["side"].to_numpy() != 2
        two = group["side"].to_numpy() != 1
        x = unit(group["embedding"].tolist())
        close = x[one] @ x[two].T >= least
        rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        a, b = np.flatnonzero(one), np.flatnonzero(two)
        close &= rep[a][:, None] != rep[b][None, :]
        hit = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        if not len(hit[0]):
            return pd.DataFrame({"rep": [], "n": [], "least": []}).astype("int64")
        a, b, close = a[hit[0]], b[hit[1]], close[np.ix_(*hit)]
        # Pairs that already met in a leaf of smaller id are counted there.
        used = np.union1d(a, b)
        nodes = [np.asarray(v) for v in group["nodes"].iloc[used]]
        flat, own = np.concatenate(nodes), np.repeat(np.arange(len(used)), [len(v) for v in nodes])
        early = flat < node
        ids, column = np.unique(flat[early], return_inverse=True)
        table = np.zeros((len(used), len(ids)), dtype=np.float32)
        table[own[early], column] = 1
        ia, ib = np.searchsorted(used, a), np.searchsorted(used, b)
        fresh = close & (table[ia] @ table[ib].T == 0)
        n = np.zeros(len(group), dtype=np.int64)
        n[a] += fresh @ copies[b]
        if not (one & two).any():
            n[b] += fresh.T @ copies[a]
        root = rep.copy()
        while True:
            low_a = np.minimum(root[a], np.where(close, root[b][None, :], np.iinfo(np.int64).max).min(axis=1))
            low_b = np.minimum(root[b], np.where(close, root[a][:, None], np.iinfo(np.int64).max).min(axis=0))
            new = root.copy()
            new[a] = low_a
            new[b] = np.minimum(new[b], low_b)
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"rep": rep[used], "n": n[used], "least": root[used]})
    return run


def near_duplicates(rows: DataFrame, least: float = 0.93, trees: int = 12, leaf: int = 256, slack: float = 0.26) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label).

    Vectors of one label whose cosine in double precision is ``least`` or more are linked. A vector that is
    null, empty, zero or holds a null or non-finite component, or has no label, links with nothing; vectors of
    different length do not link. Equal vectors of a label are one class from the start, and every one of
    them is linked with the others. Classes go by label and vector, so rows of one ``vec_id`` link each for itself.
    Rows without ``vec_id`` link like others; a component of such rows only has a null ``component_id`` and keeps
    them. Other columns are ignored; an empty table gives an empty result.
    """
    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"),
                        F.col("label").cast("int"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = (F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(finite, F.lit(False))
              & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    marked = given.withColumn("usable", usable)
    classes = reliable(marked.filter("usable").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies")).select(
        F.monotonically_increasing_id().alias("rep"), "smallest", "label", "copies", "embedding"), "vectors")
    leaves = reliable(grow(classes.drop("smallest"), trees, leaf, slack * np.sqrt(2 - 2 * least)), "leaves")
    places = leaves.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    sizes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = (salted_join(leaves, sizes, "node", "inner", spread="rep").join(places, "rep").withColumn("blocks", blocks)
              .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")))
    # Block pairs (i, j), i <= j, of a leaf; a row takes part in those of its own block.
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "label", "copies", "embedding", "node", "nodes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    found = reliable(dealt.groupBy("node", "label", "i", "j").applyInPandas(_linked(least), "rep long, n long, least long"), "links")
    groups = components(found.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = (classes.join(sums, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
             .select("label", "embedding", F.coalesce("component", "rep").alias("component"), "smallest",
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    least_ids = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    linked = marked.filter("usable").join(named.join(least_ids, "component"), ["label", "embedding"]).select(
        "vec_id", F.col("n").alias("n_links"), "component_id")
    alone = marked.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
