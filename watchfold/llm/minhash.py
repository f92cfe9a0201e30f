"""Near-duplicate documents by one-permutation MinHash with optimal densification and star-shaped candidates.

One hash of every word shingle fills ``bands * rows`` bins; an empty bin borrows from a bin drawn by a hash of
its number, so that any two signatures agree in a bin with the probability of their similarity. Bands of
``rows`` bins name buckets. In a bucket every set is paired with the smallest id only, and the pairs are
confirmed on the full shingle sets. A bucket that then still holds several components is compared whole, in
blocks of bounded size: intersections of all its full sets are counted inside the task, and each block passes on
a star per local component, so neither pairs nor links are written and a bucket loses no link.
With 20 bands of 4, a pair of similarity 0.8 meets in no bucket with probability 2.6e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfold.llm import words as W
from watchfold.llm.components import components
from watchfold.session import reliable

U64 = W.U64
EMPTY = np.iinfo(np.uint64).max
BLOCK = 256
SLICE = 4096


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of every row, a list per run of rows. A text of fewer words than ``width``
    has its whole word sequence as only shingle; a text without words has none."""
    data, offsets = W.text_buffers(column)
    for a, b in W.runs_of_rows(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, firsts = W.find_words(part, at)
        hashes = W.hash_words(part, starts, ends, lower)
        grams = W.hash_windows(hashes, width, width)
        out = []
        for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            n = j - i
            out.append(np.unique(grams[i:j - width + 1]) if n >= width
                       else W.hash_windows(hashes[i:j], n, 1000 + n) if n else np.zeros(0, dtype=U64))
        yield out


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill empty bins (``EMPTY``) of each row from a full bin named by a hash of (bin, attempt)."""
    n = bins.shape[1]
    out, own = bins.copy(), np.arange(n, dtype=U64)
    open_rows = np.flatnonzero((bins == EMPTY).any(axis=1) & (bins != EMPTY).any(axis=1))
    attempt = 0
    while len(open_rows):
        attempt += 1
        if attempt <= 4 * n:
            donor = (W.mix(own + U64(attempt * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(n)).astype(np.int64)
        else:  # every bin is asked in turn, so the search ends
            donor = (np.arange(n) + attempt) % n
        now = out[open_rows]
        fill = (now == EMPTY)
        offered = bins[open_rows][:, donor]
        now[fill] = offered[fill]
        out[open_rows] = now
        open_rows = open_rows[(now == EMPTY).any(axis=1)]
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per set and band."""
    n, count = bands * rows, len(sets)
    lens = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if count else np.zeros(0, dtype=U64)
    h = W.mix(flat ^ U64(0xA0761D6478BD642F))
    at = np.repeat(np.arange(count), lens) * n + (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)
    bins = np.full(count * n, EMPTY, dtype=U64)
    np.minimum.at(bins, at, h)
    bins = densify(bins.reshape(count, n)).reshape(count, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (count, bands)).copy()
    for r in range(rows):
        key = W.mix(key * U64(W.BASE) + bins[:, :, r])
    return key


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_a, set_b, keys): the row's digest, set size, a 128-bit digest of the set, and the bucket keys."""

    def run(batches):
        for batch in batches:
            ids, row, at = batch.column(0), batch.column(1), 0
            for sets in shingle_sets(batch.column(2), width):
                lens = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(lens)
                flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, dtype=U64)
                cuts = np.concatenate([[0], np.cumsum(lens[some])[:-1]]).astype(np.int64)
                digests = []
                for seed in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
                    digest = np.zeros(len(sets), dtype=U64)
                    if len(some):
                        digest[some] = np.add.reduceat(W.mix(flat ^ U64(seed)), cuts)
                    digests.append(digest.view(np.int64))
                keys = np.zeros((len(sets), bands), dtype=U64)
                if len(some):
                    keys[some] = band_keys([sets[i] for i in some], bands, rows)
                per_row = np.where(lens > 0, bands, 0)
                offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), row.slice(at, len(sets)), pa.array(lens), pa.array(digests[0]), pa.array(digests[1]), lists],
                    ["doc_id", "row", "n_shingles", "set_a", "set_b", "keys"])
                at += len(sets)

    return docs.select(F.col("doc_id").cast("long"), W.row_key().alias("row"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, row binary, n_shingles long, set_a long, set_b long, keys array<long>")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows that ``ids`` (id, row) names by their digest."""
    rows = docs.select(W.row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.join(ids, "row").select("id", "text").dropDuplicates(["id"])


def confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, united) of candidate ``pairs`` (a, b), counted on the full shingle sets."""

    def run(batches):
        for batch in batches:
            left = (s for part in shingle_sets(batch.column(2), width) for s in part)
            right = (s for part in shingle_sets(batch.column(3), width) for s in part)
            united, shared = [], []
            for x, y in zip(left, right):
                both = len(np.unique(np.concatenate([x, y])))
                united.append(both)
                shared.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()),
                                              pa.array(united, pa.int64())], ["a", "b", "shared", "united"])

    both = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, shared long, united long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, in slices of the values they have in common."""
    values = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
        ok = values[at] == flat if len(values) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order]

    out = np.zeros((len(left), len(right)), dtype=np.float32)
    (la, lr), (ra, rr) = places(left), places(right)
    for low in range(0, len(values), SLICE):
        tables = []
        for at, row, n in ((la, lr, len(left)), (ra, rr, len(right))):
            i, j = np.searchsorted(at, [low, low + SLICE])
            table = np.zeros((n, min(SLICE, len(values) - low)), dtype=np.float32)
            table[row[i:j], at[i:j] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def compare_blocks(members: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """(a, b): stars of the local components among the linked sets of each bucket of ``members`` (key, rep)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = [s for part in shingle_sets(group["text"].combine_chunks(), width) for s in part]
        rep, side = group["rep"].to_numpy(), group["side"].to_numpy()
        a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        out = pa.array([], pa.int64()), pa.array([], pa.int64())
        if len(a) and len(b):
            size = np.array([len(s) for s in sets], dtype=np.float64)
            both = intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
            close = 100 * both >= similarity * (size[a][:, None] + size[b][None, :] - both)
            root = rep.copy()
            while True:
                new, most = root.copy(), np.iinfo(np.int64).max
                new[a] = np.minimum(new[a], np.where(close, root[b][None, :], most).min(axis=1))
                new[b] = np.minimum(new[b], np.where(close, new[a][:, None], most).min(axis=0))
                if (new == root).all():
                    break
                root = new
            moved = root != rep
            out = pa.array(rep[moved]), pa.array(root[moved])
        return pa.table({"a": out[0], "b": out[1]})

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    placed = members.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep",
                          F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    full = dealt.join(texts.withColumnRenamed("id", "rep"), "rep")
    return full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, bands: int = 20, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, component) of every row of ``docs`` (doc_id, text).

    Documents whose shingle sets satisfy ``100 * intersection >= similarity * union`` are linked. Words are
    runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A text that is null, empty or
    without words has an empty set and links with nothing; equal sets are one class from the start.
    Classes go by their sets, so rows of one id with several texts link each for itself. Rows without ``doc_id``
    link like others; a component of such rows only has a null ``component_id`` and keeps them. ``row`` is
    the digest ``words.row_key``, ``component`` a number of the component, null for empty sets; other columns are ignored; an empty table gives an empty result.
    """
    signed = reliable(signatures(docs, width, bands, rows), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("row", "keys")).alias("first"))
    # The number of a class holds once it is written; ids may repeat or be null.
    classes = reliable(classes.select("n_shingles", "set_a", "set_b", "least", F.monotonically_increasing_id().alias("rep"),
                                      F.col("first.row").alias("row"), F.col("first.keys").alias("keys")), "classes")
    members = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = reliable(members.join(hubs, "key"), "buckets")
    stars = shared.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    # Only sets that share a bucket are looked at in full, and their texts are moved once.
    texts = reliable(texts_of(docs, classes.join(shared.select("rep").distinct(), "rep").select(F.col("rep").alias("id"), "row")), "texts")
    linked = confirm(stars, texts, width).filter(F.expr(f"100 * shared >= {similarity} * united"))
    groups = reliable(components(linked), "components")
    placed = shared.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    # Two sets are a hub and one other, which are already confirmed.
    mixed = mixed.filter("x <> y and n > 2").select("key")
    across = compare_blocks(placed.join(mixed, "key").select("key", "rep"), texts, width, similarity)
    first = groups.select(F.col("id").alias("a"), F.col("component").alias("x"))
    second = groups.select(F.col("id").alias("b"), F.col("component").alias("y"))
    lifted = across.distinct().join(first, "a", "left").join(second, "b", "left").select(
        F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    top = reliable(components(lifted), "components").select(F.col("id").alias("component"), F.col("component").alias("over"))
    nodes = groups.union(top.select("component", "component")).distinct()
    groups = nodes.join(top, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
    grouped = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "component").select("n_shingles", "set_a", "set_b", "component_id", "component")
    return signed.select("doc_id", "row", "n_shingles", "set_a", "set_b").join(
        named, ["n_shingles", "set_a", "set_b"], "left").withColumn(
        "component_id", F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "component")


def keep_one(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns: of each component the row of smallest id.

    Rows equal in id and text are one document. Ties of an id go by the digest of the row; a row without id stays
    only where its component has none with one. Documents without words stay.
    """
    found = reliable(near_duplicates(docs, width, similarity).select("doc_id", "row", "component"), "found")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    first = found.filter("component is not null").groupBy("component").agg(least.alias("first")).select("first.row")
    others = found.filter("component is null").select("row")
    at = "row"
    while at in docs.columns:
        at += "_"
    stays = first.union(others).distinct().withColumnRenamed("row", at)
    return docs.withColumn(at, W.row_key()).join(stays, at, "left_semi").dropDuplicates([at]).select(*docs.columns)
