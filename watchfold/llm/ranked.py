"""Ranked lexical search: the highest-scoring documents of each item, by presence masks.

Documents are read once into postings of the items' terms. In each block of documents a bitmap per term tells which
documents hold it; an item's bitmaps give every document a mask of the item's terms that it matches. Documents with
one mask form a group, whose highest possible score follows from the mask, the highest term frequencies of the block
and the shortest document of the group. Groups are scored by descending highest score, until the k-th score reached
so far in the task is above what the next group can reach: the rest cannot enter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchfold.llm import words as W
from watchfold.llm.tokens import column_runs
from watchfold.session import reliable

# Distinct (item, term) pairs that go to the tasks at once; further items are ranked in further blocks.
PAIRS = 1 << 16
# Cells (documents x terms) of one block of bitmaps and contributions.
CELLS = 1 << 23
# Documents that the first step of groups holds; each further step doubles.
FIRST = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def terms_of(text: str) -> Column:
    """Terms of a text: runs of letters, digits and everything beyond ASCII, only A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), LETTERS, LETTERS.lower()), F.lit(TERM), 0)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items`` (item_id, text)."""
    read = items.select(F.col("item_id").cast("long"), F.explode(terms_of("text")).alias("term"))
    return read.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class Items:
    """Items of one block: their distinct terms, and for each item the numbers and times of its terms."""

    ids: list[int | None] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    terms: list[bytes] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list) -> Items:
        made = cls(terms=sorted({r.term.encode() for r in rows}))
        number = {t: i for i, t in enumerate(made.terms)}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append((number[r.term.encode()], r.times))
        for item, pairs in by_item.items():
            made.ids.append(item)
            made.numbers.append(np.array([n for n, _ in sorted(pairs)], dtype=np.int64))
            made.times.append(np.array([t for _, t in sorted(pairs)], dtype=np.int64))
        return made


class Finder:
    """Finds the occurrences of given terms in the bytes of many texts."""

    def __init__(self, terms: list[bytes]):
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        self.body = np.frombuffer(b"".join(terms), dtype=np.uint8)
        self.at = np.cumsum(sizes) - sizes
        self.sizes = sizes
        hashes = W.hash_words(self.body, self.at, self.at + sizes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(self.hashes)) < len(terms):
            raise ValueError("two terms share a 64-bit hash")
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes & W.U64(len(self.maybe) - 1)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row, and row and term number of every occurrence of a given term."""
        none = np.zeros(0, dtype=np.int64)
        if not len(data):
            return np.zeros(len(offsets) - 1, dtype=np.int64), none, none
        inside = _INSIDE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        firsts = np.searchsorted(starts, offsets)
        h = W.hash_words(data, starts, ends, lower=True)
        some = np.flatnonzero(self.maybe[(h & W.U64(len(self.maybe) - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        same = self.hashes[spot] == h[some]
        some, term = some[same], self.order[spot[same]]
        same = (ends - starts)[some] == self.sizes[term]
        some, term = some[same], term[same]
        equal = self._equal(data, starts[some], term)
        some, term = some[equal], term[equal]
        row = np.searchsorted(firsts, some, side="right") - 1
        return np.diff(firsts), row, term

    def _equal(self, data: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the bytes from each start are those of its term, A-Z lower-cased."""
        out = np.ones(len(starts), dtype=bool)
        step = 1 << 16
        for a in range(0, len(starts), step):
            size = self.sizes[term[a:a + step]]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            theirs = self.body[np.repeat(self.at[term[a:a + step]], size) + inner]
            ours = data[np.repeat(starts[a:a + step], size) + inner]
            ours = ours + ((ours >= 0x41) & (ours <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
            wrong = np.flatnonzero(ours != theirs)
            if len(wrong):
                out[a + np.searchsorted(np.cumsum(size), wrong, side="right")] = False
        return out


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of ``docs``: its terms with repeats, and the items' terms in it."""
    wanted = items.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(wanted)
        for batch in batches:
            for a, b, data, offsets in column_runs(batch.column(1)):
                n, row, term = finder.find(data, offsets)
                key, tf = np.unique(row * len(wanted) + term, return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(b - a + 1) * len(wanted)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((key % len(wanted)).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best k (score, document) of one item so far: score descending, then document ascending, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def least(self) -> int:
        """What a document has to reach to enter, ties included."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        best = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


def masks_of(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of the columns of ``bitmaps`` (terms x documents) as rows of bits, and each document's mask."""
    terms = len(bitmaps)
    packed = np.zeros((bitmaps.shape[1], (terms + 63) // 64 * 8), dtype=np.uint8)
    packed[:, :(terms + 7) // 8] = np.packbits(bitmaps, axis=0, bitorder="little").T
    words = packed.view(np.uint64)
    if words.shape[1] == 1:
        _, one, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        whole = packed.view([("", f"V{packed.shape[1]}")])[:, 0]
        _, one, group = np.unique(whole, return_index=True, return_inverse=True)
    return bitmaps[:, one].T, group.reshape(-1)


def rank_block(items: Items, weight: np.ndarray, best: list[Best], doc: np.ndarray, null: np.ndarray, m: np.ndarray,
               row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> int:
    """Lets the documents of one block enter the items' best; returns how many (item, document) pairs were scored."""
    rows, scored = len(doc), 0
    contribution = np.zeros((len(items.terms), rows), dtype=np.int64)
    contribution[term, row] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
    bitmap = np.zeros((len(items.terms), rows), dtype=bool)
    bitmap[term, row] = True
    most = np.zeros(len(items.terms), dtype=np.int64)
    np.maximum.at(most, term, tf)
    present = bitmap.any(axis=1)
    for numbers, times, top in zip(items.numbers, items.times, best):
        here = present[numbers]
        numbers, times = numbers[here], times[here]
        if not len(numbers):
            continue
        held, group = masks_of(bitmap[numbers])
        shortest = np.full(len(held), np.iinfo(np.int64).max)
        np.minimum.at(shortest, group, m)
        reach = (weight[numbers] * times) * (1_000_000_000 * most[numbers] // (1000 * most[numbers] + 12 * shortest[:, None]))
        highest = (reach * held).sum(axis=1)
        by_reach = np.argsort(-highest, kind="stable")
        place = np.empty_like(by_reach)
        place[by_reach] = np.arange(len(by_reach))
        order = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(held))[by_reach])
        at, step = 0, FIRST
        while at < rows:
            open_groups = int(np.searchsorted(-highest[by_reach], -top.least(), side="right"))
            limit = int(ends[open_groups - 1]) if open_groups else 0
            if at >= limit:
                break
            to = min(limit, int(ends[np.searchsorted(ends, min(at + step, rows))]))
            some = order[at:to]
            score = times @ contribution[np.ix_(numbers, some)]
            enters = score >= top.least()
            top.add(score[enters], doc[some[enters]], null[some[enters]])
            scored += len(some)
            at, step = to, 2 * step
    return scored


def local_best(found: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of every item among the postings of each task."""
    columns = "item_id long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.ids]
        step = max(1, CELLS // len(items.terms))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                m = batch.column(1).to_numpy(zero_copy_only=False)
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                rank_block(items, weight, best, doc, null, m, np.repeat(np.arange(len(doc)), sizes), term, tf)
        for item, top in zip(items.ids, best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(top.score), pa.int64()), pa.array(top.doc, mask=top.null),
                                                  pa.array(top.score)], ["item_id", "doc_id", "score"])

    return found.select("doc_id", "m", "terms", "tfs").mapInArrow(run, columns)


def first_k(scored: DataFrame, keys: list, k: int) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scored.withColumn("rank", ranked).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each item.

    Scores are those of the module's contract: integer weights from document frequencies over all of ``docs``, term
    frequencies damped by length. ``items`` (item_id, text) are the stated queries; rows that share an item_id are one
    item with the terms of all of them, an item without terms or without a match has no rows. Only scores above 0
    count; equal scores rank by ascending doc_id, null ids last. Repeated rows of ``docs`` are documents of their own.
    Null and empty texts hold no term. Texts of any length are read whole; other columns are ignored; empty tables
    give an empty result. Items go to the tasks in blocks of some ``PAIRS`` (item, term) pairs, a block per pass over
    the texts; an item that alone has more is a block of its own size.
    """
    spark = docs.sparkSession
    wanted = reliable(item_terms(items), "item_terms")
    blocks = max(1, math.ceil(wanted.count() / PAIRS))
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        of_block = Items.of(numbered.filter(F.col("block") == block).select("item_id", "term", "times").collect())
        if not of_block.terms:
            continue
        found = reliable(postings(docs, of_block), "postings")
        size = found.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        if not size.n:
            continue
        ratio = (2.0 * size.n + 2) / (2 * F.col("df") + 1)
        weights = (found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                   .select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("w")).collect())
        weight = np.zeros(len(of_block.terms), dtype=np.int64)
        weight[[r.term for r in weights]] = [r.w for r in weights]
        m = F.expr(f"75 + cast(25 as decimal(38, 0)) * n * {size.n}BD div {size.l}BD")
        best = local_best(found.filter(F.size("terms") > 0).withColumn("m", m.cast("long")), of_block, weight, k)
        # A slice of the tasks first, so that no task meets all of an item's candidates.
        sliced = first_k(best.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(64))), ["item_id", "slice"], k)
        out = out.union(first_k(sliced.drop("rank", "slice"), ["item_id"], k).select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
