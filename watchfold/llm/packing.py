"""Packing of tokenized documents into training sequences, by lexical retrieval.

Documents are encoded once and dealt into shards of about ``shard_tokens`` tokens by content: in the order of their
two most telling terms, by frequencies of the whole table, so that related documents meet at any size. A shard
holds an inverted index over token ids with BM25 weights (document frequencies and lengths are those of the whole
table). Full windows are cut from long documents first. Then a seed document opens a window, and all unused
documents of the shard that share a term with it fill the window greedily, best first; the best one that no longer
fits is cut, and what is left of it seeds the next window. Only where no unused document shares a term with the
seed does the longest unused one follow, as the next seed. The last, short window of a shard is cut at powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchfold.llm import tokens as T
from watchfold.session import reliable

K1, B = 1.2, 0.75
LEAST = 64  # a document counts as so many tokens at least when shards are cut, so none has very many rows


def tokenized(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, slot, n, ids): ids as little-endian 16-bit values with the end id; ``slot`` deals rows out evenly."""

    def run(batches):
        coder = T.word_ids(vocabulary)
        for batch in batches:
            for a, b, data, offsets in T.column_runs(batch.column(2)):
                ids, at = coder.encode(data, offsets)
                raw = ids.astype("<u2").tobytes()
                tail = int(end).to_bytes(2, "little")
                rows = [raw[2 * i:2 * j] + tail for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at) + 1),
                     pa.array(rows, pa.binary())], ["doc_id", "slot", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("slot"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, slot long, n long, ids binary")


def document_frequencies(coded: DataFrame) -> np.ndarray:
    """In how many documents each id occurs; bounded by the vocabulary (16-bit ids)."""

    def run(batches):
        seen = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                seen[np.unique(np.frombuffer(ids, dtype="<u2"))] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["id", "n"])

    found = coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, dtype=np.int64)
    out[[r["id"] for r in found]] = [r["n"] for r in found]
    return out


def bm25(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def telling_terms(coded: DataFrame, idf: np.ndarray, shared: np.ndarray, mean: float, end: int) -> DataFrame:
    """(slot, n, load, key) of ``coded``: ``key`` packs the two terms of highest BM25 weight among those that other
    documents have too, or is null without any."""

    def run(batches):
        for batch in batches:
            keys = [key_of(np.frombuffer(x, dtype="<u2"), idf, shared, mean, end) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["slot", "n", "key"])

    keyed = coded.select("slot", "n", "ids").mapInArrow(run, "slot long, n long, key long")
    return keyed.withColumn("load", F.greatest("n", F.lit(LEAST)))


def key_of(ids: np.ndarray, idf: np.ndarray, shared: np.ndarray, mean: float, end: int) -> int | None:
    terms, tf = np.unique(ids, return_counts=True)
    ok = shared[terms] & (terms != end)
    terms, tf = terms[ok], tf[ok]
    if not len(terms):
        return None
    best = terms[np.argsort(-bm25(idf[terms], tf, len(ids), mean), kind="stable")[:2]].tolist()
    return best[0] << 16 | (best[1] if len(best) > 1 else 0)


class Deal:
    """Shards as ranges of keys of about ``shard_tokens`` each; a key with more than that has shards of its own, by hash."""

    def __init__(self, keyed: DataFrame, shard_tokens: int):
        loads = keyed.groupBy("key").agg(F.sum("load").alias("load")).withColumn("term", F.shiftright("key", 16))
        loads = reliable(loads, "keys")
        total = loads.agg(F.sum("load")).first()[0] or 0
        loads = loads.filter("key is not null")
        # One row per leading term, at most 65,536, then the keys of each term in order.
        tops = loads.groupBy("term").agg(F.sum("load").alias("all"))
        past = Window.rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.withColumn("before", F.coalesce(F.sum("all").over(past.partitionBy(F.lit(0)).orderBy("term")), F.lit(0))).drop("all")
        placed = loads.join(tops, "term").withColumn(
            "at", F.col("before") + F.coalesce(F.sum("load").over(past.partitionBy("term").orderBy("key")), F.lit(0)))
        hot = F.when(F.col("load") > shard_tokens, F.col("key"))
        rows = placed.groupBy(F.floor(F.col("at") / shard_tokens).alias("range"), hot.alias("hot")).agg(
            F.min("key").alias("key"), F.max("load").alias("load")).collect()
        # At most two rows for each shard: its first key, and a hot key in it; what follows a hot key is in a later range.
        starts = {r["key"]: -(-r["load"] // shard_tokens) if r["hot"] is not None else 1 for r in rows}
        self.starts = np.array(sorted(starts), dtype=np.int64)
        self.parts = np.array([starts[k] for k in self.starts.tolist()], dtype=np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        self.shards = max(1, int(self.parts.sum()), -(-total // shard_tokens))

    def shard(self, key: int | None, slot: int) -> int:
        """Documents that share no term with any other go anywhere."""
        if key is None:
            return slot % self.shards
        j = int(np.searchsorted(self.starts, key, side="right")) - 1
        return int(self.first[j]) + slot % int(self.parts[j])


class Index:
    """BM25 postings of the unused documents of one shard; the id ``end`` of all documents is no term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, end: int | None = None):
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        pair, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, doc = pair // len(docs), pair % len(docs)
        weight = bm25(idf[term], tf, np.array([len(d) for d in docs])[doc], mean)
        text = term != (-1 if end is None else end)
        self.size = len(docs)
        self._keep(term[text], doc[text], weight[text].astype(np.float64))

    def _keep(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight = term, doc, weight
        self.first = np.searchsorted(term, np.arange((1 << 16) + 1))
        self.postings = np.bincount(doc, minlength=self.size)

    def neighbours(self, ids: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``ids``, by the BM25 score over all shared terms, best first."""
        if 2 * self.postings[unused].sum() < len(self.doc):
            some = unused[self.doc]
            self._keep(self.term[some], self.doc[some], self.weight[some])
        terms = np.unique(ids)
        spans = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms.astype(np.int64) + 1].tolist()) if a < b]
        if not spans:
            return np.zeros(0, dtype=np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]),
                            minlength=self.size)
        score[~unused] = 0
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]


def pack_shard(docs: list[np.ndarray], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard."""
    out, sequence = [], 0
    start = np.zeros(len(docs), dtype=np.int64)
    size = np.array([len(d) for d in docs])
    for i in range(len(docs)):
        while size[i] - start[i] >= window:
            out.append((i, int(start[i]), window, sequence, 0))
            start[i] += window
            sequence += 1
    unused = size > start
    order = iter(np.argsort(-(size - start), kind="stable").tolist())
    seed, filled, current = None, 0, []

    def put(i: int) -> bool:
        """Add what fits of document ``i`` to the window; true if some of it is left."""
        nonlocal filled
        n = int(min(size[i] - start[i], window - filled))
        current.append((i, int(start[i]), n, filled))
        start[i] += n
        filled += n
        unused[i] = size[i] > start[i]
        return bool(unused[i])

    while unused.any():
        if seed is None:
            seed = next(i for i in order if unused[i])
        rest = seed if put(seed) else None
        if filled < window:
            ranked = index.neighbours(docs[seed], unused)
            left, at = size[ranked] - start[ranked], 0
            taken = np.zeros(len(ranked), dtype=bool)
            while filled < window:
                fits = left[at:] <= window - filled
                step = int(fits.argmax()) if len(fits) else 0
                if not len(fits) or not fits[step]:
                    break
                at += step
                put(int(ranked[at]))
                taken[at] = True
                at += 1
            if filled < window and not taken.all():
                best = int(ranked[taken.argmin()])
                rest = best if put(best) else None
        seed = rest
        # A window that nothing else of the shard shares a term with stays open for the next seed.
        if filled == window:
            out += [(i, s, n, sequence, at) for i, s, n, at in current]
            sequence, filled, current = sequence + 1, 0, []
    # What is left of the shard: sequences of a power of two each.
    cut, at = 0, 0
    for i, s, n, _ in current:
        while n:
            if at == cut:
                cut, at = 1 << ((filled).bit_length() - 1), 0
                filled -= cut
                sequence += 1
            m = min(n, cut - at)
            out.append((i, s, m, sequence - 1, at))
            s, n, at = s + m, n - m, at + m
    return out


def pack(docs: DataFrame, window: int = 4096, vocabulary: str = "word_bpe_49k.json", end: int = 2,
         shard_tokens: int = 1_500_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): pieces of all rows of ``docs`` (doc_id, text).

    A document is its ids followed by the id ``end``; a null or empty text is that id alone. Every id lies in
    exactly one piece; a sequence holds at most ``window`` ids without gaps. Sequences are full, but for those
    at the end of a shard, whose lengths are powers of two. Repeated rows are packed as documents of their own;
    a null ``doc_id`` stays null; other columns are ignored; an empty table gives an empty result.
    """
    coded = reliable(tokenized(docs, vocabulary, end), "ids")
    rows, total = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = document_frequencies(coded)
    idf = np.log(1 + (rows - seen + 0.5) / (seen + 0.5))
    mean = total / max(rows, 1)
    hidden = idf.astype(np.float32)
    shared = seen > 1
    deal = Deal(telling_terms(coded, hidden, shared, mean, end), shard_tokens)

    def place(batches):
        for batch in batches:
            ids, slots = batch.column("ids").to_pylist(), batch.column("slot").to_pylist()
            shard = [deal.shard(key_of(np.frombuffer(x, dtype="<u2"), hidden, shared, mean, end), s) for x, s in zip(ids, slots)]
            yield batch.append_column("shard", pa.array(shard, pa.int64()))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("slot", "ascending")]).combine_chunks()
        texts = [np.frombuffer(x, dtype="<u2") for x in group["ids"].to_pylist()]
        pieces = pack_shard(texts, Index(texts, hidden, mean, end), window)
        doc = np.array([p[0] for p in pieces])
        crc = [zlib.crc32(texts[i][s:s + n].astype("<u4").tobytes()) for i, s, n, _, _ in pieces]
        shard = group["shard"][0].as_py() << 32
        return pa.table({
            "doc_id": group["doc_id"].take(pa.array(doc)), "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": group["n"].take(pa.array(doc)), "sequence_id": pa.array([shard + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64())})

    return coded.mapInArrow(place, f"{', '.join(f'{c} {t}' for c, t in coded.dtypes)}, shard long").groupBy("shard").applyInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
