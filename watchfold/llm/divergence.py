"""How far the sources of each language differ in their words, from exact sparse document vectors.

`CountVectorizer` with a least document frequency and the largest integer as vocabulary size turns every document into
a sparse vector of exact counts. Terms carry their language as a prefix, so one fit holds a vocabulary for each
language, whatever the number of languages. Vectors are summed per source as sparse entries, as `Summarizer` sums
them, and pairs of sources are evaluated over the terms that at least one of the two holds; the rest of the
vocabulary contributes one constant per pair.

The vocabulary passes through the driver and is sent to all tasks, so it is bounded: a first fit asks for at most
``TERMS`` terms. A vocabulary that stays below that is the whole one. Otherwise it is thrown away, terms are dealt by
hash to as many blocks as keep the distinct terms of each below ``TERMS``, and each block, which holds its own terms
only, has a fit with the largest integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchfold.session import reliable, shared_dir

TERMS = 1 << 22
# Terms of one range of a vocabulary, and sources of one tile, that are evaluated together in a task.
RANGE = 4096
TILE = 64
SCALE = 1_000_000_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHERS = "".join(chr(c) for c in (*range(0x20), *range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
SEPARATOR = "\x00"  # occurs in no term


def _spaced(text: Column) -> Column:
    """Terms of a text with spaces between them: runs of letters and everything beyond ASCII, only A-Z lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.regexp_replace(F.lower(text), "[^a-z]+", " ")).otherwise(
        F.translate(text, LETTERS + OTHERS, LETTERS.lower() + " " * len(OTHERS)))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def prefixed_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms) of every row; each term with its language, as hexadecimal digits, before it."""
    read = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _spaced(_text("text")).alias("spaced"))
    prefix = F.concat(F.hex("lang"), F.lit(SEPARATOR))
    each = F.concat(prefix, F.replace("spaced", F.lit(" "), F.concat(F.lit(" "), prefix)))
    return read.select("lang", "source", F.array_remove(F.split(each, " "), prefix).alias("terms"))


def dealt_to_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, terms, block): the terms of every row by the block that their hash names; counts stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            hashed = np.array([int.from_bytes(_digest(t), "little") % blocks for t in coded.dictionary.to_pylist()])
            block = hashed[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            key = row * blocks + block
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            at = pa.array(np.append(first, len(order)).astype(np.int32))
            terms = pa.ListArray.from_arrays(at, coded.dictionary.take(coded.indices.take(pa.array(order))))
            of = pa.array(keys // blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), terms,
                                              pa.array((keys % blocks).astype(np.int32))], ["lang", "source", "terms", "block"])

    return rows.select("lang", "source", "terms").mapInArrow(run, "lang string, source string, terms array<string>, block int")


def _digest(term: str) -> bytes:
    import hashlib
    return hashlib.blake2b(term.encode(), digest_size=8).digest()


class _Sums:
    """Sums of sparse vectors by source, kept as sorted sparse entries."""

    def __init__(self):
        self.sources: dict[str, int] = {}
        self.keys, self.counts, self.waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def add(self, source: pa.Array, places: pa.ListArray, counts: pa.ListArray) -> None:
        coded = source.dictionary_encode()
        of = np.array([self.sources.setdefault(s, len(self.sources)) for s in coded.dictionary.to_pylist()], dtype=np.int64)
        row = np.repeat(of[coded.indices.to_numpy()], pc.list_value_length(places).to_numpy(zero_copy_only=False))
        self.waiting.append((row << 32 | places.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)))
        if sum(len(k) for k, _ in self.waiting) > max(1 << 20, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting))
        self.waiting = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _sums_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        sums.add(batch.column(0), batch.column(1), batch.column(2))
    sums.settle()
    names = pa.array(list(sums.sources), pa.string())
    for a in range(0, len(sums.keys), 1 << 16):
        keys, counts = sums.keys[a:a + (1 << 16)], sums.counts[a:a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(keys >> 32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)],
                                         ["source", "place", "count"])


def fitted(rows: DataFrame, least_documents: int, most_terms: int = 2**31 - 1) -> CountVectorizerModel:
    return CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least_documents), vocabSize=most_terms).fit(rows)


def vector_sums(rows: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """(lang, source, place, term, count) of the terms of one model: sparse sums of its document vectors."""
    spark = rows.sparkSession
    pairs = [w.split(SEPARATOR, 1) for w in model.vocabulary]
    words = spark.createDataFrame([(i, bytes.fromhex(p).decode(), w) for i, (p, w) in enumerate(pairs)], "place int, lang string, term string")
    vectors = model.transform(rows).select("source", F.unwrap_udt("vector").alias("vector"))
    partial = vectors.select("source", "vector.indices", "vector.values").mapInArrow(_sums_of_task, "source string, place int, count long")
    sums = partial.groupBy("source", "place").agg(F.sum("count").alias("count"))
    return sums.join(words, "place").select("lang", "source", "place", "term", "count")


def group_counts(docs: DataFrame, least_documents: int, most_terms: int = TERMS) -> tuple[DataFrame, DataFrame]:
    """Occurring (lang, source) groups, and (lang, source, place, term, count) of their kept terms; both written tables."""
    spark = docs.sparkSession
    rows = reliable(prefixed_terms(docs), "source_terms")
    groups = reliable(rows.select("lang", "source").distinct(), "source_groups")
    path = shared_dir(spark, "source_counts")
    whole = fitted(rows, least_documents, most_terms)
    if len(whole.vocabulary) < most_terms:
        vector_sums(rows, whole).write.parquet(f"{path}/block=0")
    else:
        distinct = rows.select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term", 0.02)).first()[0]
        blocks = math.ceil(1.1 * distinct / most_terms)
        dealt = shared_dir(spark, "dealt_terms")
        dealt_to_blocks(rows, blocks).write.partitionBy("block").parquet(dealt)
        table = spark.read.parquet(dealt)
        for block in range(blocks):
            of_block = table.filter(F.col("block") == block)
            vector_sums(of_block, fitted(of_block, least_documents)).write.parquet(f"{path}/block={block}")
    return groups, spark.read.parquet(path).select("lang", "source", "block", "place", "term", "count")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; null for an empty vocabulary."""
    upper, lower = count + 2, total + 2 * terms
    wide = _divide(F.lit(SCALE).cast("decimal(38, 0)") * upper.cast("decimal(20, 0)"), lower.cast("decimal(20, 0)"))
    return F.when(upper < 2**63 // SCALE, _divide(SCALE * upper, lower)).otherwise(wide) + 1


def _divide(upper: Column, lower: Column) -> Column:
    return F.call_function("div", upper, lower)


def _distance(p: Column, q: Column) -> Column:
    return _divide((p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums over the terms that one of two sources holds, for the pairs of one tile and range of terms."""
    lang = table.column("lang")[0].as_py()
    source = table.column("source").combine_chunks().dictionary_encode()
    names, of = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
    p, zero, place, tile = (table.column(c).to_numpy() for c in ("p", "p_zero", "term_number", "tile"))
    first, second = table.column("tile_a")[0].as_py(), table.column("tile_b")[0].as_py()
    _, column = np.unique(place, return_inverse=True)
    shares = np.empty((len(names), column.max() + 1), dtype=np.int64)
    held = np.zeros(shares.shape, dtype=bool)
    tiles = np.empty(len(names), dtype=np.int64)
    shares[of], tiles[of] = zero[:, None], tile
    shares[of, column], held[of, column] = p, place >= 0
    out = []
    for a in np.flatnonzero(tiles == first).tolist():
        for b in np.flatnonzero(tiles == second).tolist():
            if first == second and b <= a:
                continue
            either = np.flatnonzero(held[a] | held[b])
            x, y = shares[a, either], shares[b, either]
            out.append((*sorted((names[a], names[b])), int(((x - y) * (x - y) // (x + y)).sum()), len(either)))
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "one": pa.array(columns[0], pa.string()),
                     "other": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64()),
                     "held": pa.array(columns[3], pa.int64())})


def audit(docs: DataFrame, least_documents: int = 10, top_terms: int = 10, most_terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language, and by which terms.

    Shares ``p`` of kept terms are smoothed and scaled integers, the distance of two shares is
    floor((p - q)² / (p + q)). Part ``pair``: every other source of the language and the sum of the distances over all
    kept terms, all ranks. Part ``term``: the terms that the source holds more often than its language as a whole, the
    ``top_terms`` farthest. Ranks go by descending value, then by the item's bytes.

    Null texts, languages and sources of ``docs`` (text, lang, source) are empty strings, which are values like others.
    Every row is a document of its own, repeated ones too. A group without terms, or of a language without kept terms,
    still has its pairs (value 0 in the latter case). Texts of any length are read whole; other columns are ignored; an
    empty table gives an empty result. Sums are exact up to 2^53 occurrences of a term in a document.
    """
    groups, counts = group_counts(docs, least_documents, most_terms)
    # One row per group and one per language: both small.
    of_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_term = counts.groupBy("lang", "block", "place").agg(F.sum("count").alias("lang_count"))
    of_lang = of_term.groupBy("lang").agg(F.sum("lang_count").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    sizes = (groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"]))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sizes = reliable(sizes.withColumn("tile", F.floor(numbered / TILE).cast("long"))
                     .withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
                     .withColumn("p_zero", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))), "source_sizes")
    shares = counts.join(sizes, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms")))

    numbers = ["lang", "source", "p", "p_zero", "tile", "tiles", "block", "range", "term_number"]
    placed = shares.withColumns({"range": F.floor(F.col("place") / RANGE), "term_number": F.col("place").cast("long") % RANGE}).select(numbers)
    # Every source meets every range of its language's terms, also where it holds none of them.
    present = placed.select("lang", "block", "range").distinct().join(sizes, "lang").withColumns(
        {"p": F.col("p_zero"), "term_number": F.lit(-1).cast("long")}).select(numbers)
    tiled = placed.union(present).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"tile_a": F.least("tile", "to"), "tile_b": F.greatest("tile", "to")}).drop("to", "tiles")
    partial = tiled.groupBy("lang", "block", "range", "tile_a", "tile_b").applyInArrow(
        _pair_sums, "lang string, one string, other string, value long, held long")
    summed = partial.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    both = summed.union(summed.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value", "held"))
    one = sizes.select("lang", F.col("source").alias("one"), "terms", "p_zero")
    other = sizes.select("lang", F.col("source").alias("other"), F.col("p_zero").alias("q_zero"))
    rest = (F.col("terms") - F.coalesce("held", F.lit(0))) * _distance(F.col("p_zero"), F.col("q_zero"))
    pairs = (one.join(other, "lang").filter("one <> other").join(both, ["lang", "one", "other"], "left")
             .select("lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("other").alias("item"),
                     F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0).cast("long").alias("value")))

    q = _share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    terms = (shares.join(of_term, ["lang", "block", "place"]).withColumn("q", q).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     _distance(F.col("p"), F.col("q")).cast("long").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (pairs.withColumn("rank", place).union(terms.withColumn("rank", place).filter(F.col("rank") <= top_terms))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int")))
