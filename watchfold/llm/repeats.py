"""Long word sequences that repeat across or within documents, by compaction of a sparse De Bruijn graph.

Every window of ``window`` words is represented by the k-mer of smallest hash inside it (its anchor), so two
equal windows have the same anchor at the same place. Anchors are the nodes of the graph; the words from one
anchor of a document to the next form an edge. Only nodes that occur more than once can lie in repeated windows.
A node parts if its occurrences do not all go on with the same edge, and meets if they do not all come by the
same edge; elsewhere the path does not branch. A join brings this back to the source coordinates, and the
nonbranching paths compact to one span per occurrence. A span repeats as a whole, since all occurrences of its
first node follow the same edges, and it is the same for all of them. Windows that lie in no compacted span (around
branches and the ends of a repeat) but have a repeated anchor are verified one by one: together with the
anchor, their word-sequence hash (128 bits in all) must occur at a second coordinate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchfold.llm import words as W
from watchfold.session import reliable

U64 = W.U64
# Windows of a node meet in one task up to this many occurrences (some 60 MB of rows).
HOT = 200_000


def anchors_of(nodes: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` consecutive k-mers the index of the smallest hash, the first on a tie."""
    at, span = np.arange(len(nodes)), 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(nodes[right] < nodes[left], right, left)
        span *= 2
    if span < width:
        left, right = at[:-(width - span)], at[width - span:]
        at = np.where(nodes[right] < nodes[left], right, left)
    return at


class Run:
    """Words of a run of rows, with window starts that stay inside one row and their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, k: int):
        self.starts, self.ends, self.firsts = W.find_words(data, offsets)
        self.words = W.hash_words(data, self.starts, self.ends)
        self.counts = np.diff(self.firsts)
        windows = np.maximum(self.counts - window + 1, 0)
        row = np.repeat(np.arange(len(windows)), windows)
        self.row = row
        self.at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + self.firsts[row]
        if len(row):
            self.nodes = W.hash_windows(self.words, k, 7)
            self.anchor = anchors_of(self.nodes, window - k + 1)[self.at]
        else:
            self.nodes, self.anchor = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(d, doc_id, text): ``d`` is a 128-bit digest of id and text, so rows of null or repeated ids stay apart by text."""
    return docs.select(W.row_key().alias("d"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def occurrences(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(d, i, at, node, edge, back): the anchors of every row in order, with the hashes of the words up to the next
    and from the last."""

    def run(batches):
        for batch in batches:
            d = batch.column(0)
            data, offsets = W.text_buffers(batch.column(1))
            for a, b in W.runs_of_rows(offsets):
                r = Run(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], window, k)
                if not len(r.row):
                    continue
                at = np.unique(r.anchor)
                row = np.searchsorted(r.firsts, at, side="right") - 1
                same = row[1:] == row[:-1]
                edge = np.zeros(len(at), dtype=U64)
                edge[:-1][same] = W.hash_spans(r.words, at[:-1][same], at[1:][same] + k) | U64(1)
                back = np.concatenate([[U64(0)], edge[:-1]])
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                i = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                source = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [d.take(source), pa.array(i.astype(np.int32)),
                     pa.array((at - r.firsts[row]).astype(np.int32)), pa.array(r.nodes[at].view(np.int64)),
                     pa.array(edge.view(np.int64)), pa.array(back.view(np.int64))],
                    ["d", "i", "at", "node", "edge", "back"])

    return rows.select("d", "text").mapInArrow(run, "d binary, i int, at int, node long, edge long, back long")


def repeated_nodes(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(d, nodes): per row its repeated anchors (i, at, parts, meets, hot); ``hot`` says that the node has more
    than ``HOT`` occurrences."""
    found = occurrences(rows, window, k)
    often = found.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2"),
                                      F.min("back").alias("b1"), F.max("back").alias("b2")).filter("n > 1")
    often = often.selectExpr("node", "e1 <> e2 or e1 = 0 as parts", "b1 <> b2 or b1 = 0 as meets", f"n > {HOT} as hot")
    placed = found.select("d", "i", "at", "node").join(often, "node")
    return placed.groupBy("d").agg(F.collect_set(F.struct("i", "at", "parts", "meets", "hot")).alias("nodes"))


def _lists(column: pa.Array):
    """Row number and values of a column of lists, flat; null lists are empty."""
    lens = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lens)), lens), column.flatten()


def _ints(column: pa.Array, firsts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Values of list rows a..b as positions in the run's words."""
    row, values = _lists(column.slice(a, b - a))
    return firsts[row] + values.to_numpy(zero_copy_only=False).astype(np.int64)


class Nodes:
    """Repeated anchors of rows a..b as positions in the run's words, and their compacted spans."""

    def __init__(self, column: pa.Array, firsts: np.ndarray, a: int, b: int, k: int, window: int):
        row, values = _lists(column.slice(a, b - a))
        i, at, parts, meets, hot = (values.field(n).to_numpy(zero_copy_only=False) for n in ("i", "at", "parts", "meets", "hot"))
        order = np.lexsort((i, row))
        row, i, parts, meets = row[order], i[order], parts[order].astype(bool), meets[order].astype(bool)
        self.at, self.hot = firsts[row] + at[order].astype(np.int64), hot[order].astype(bool)
        begins = np.ones(len(row), dtype=bool)
        begins[1:] = ~((row[1:] == row[:-1]) & (i[1:] == i[:-1] + 1) & ~parts[:-1] & ~meets[1:])
        first = np.flatnonzero(begins)
        last = np.append(first, len(row))[1:] - 1
        starts, ends = self.at[first], self.at[last] + k
        long = ends - starts >= window
        self.starts, self.ends = starts[long], ends[long]


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def open_windows(rows: DataFrame, nodes: DataFrame, window: int, k: int) -> DataFrame:
    """(d, hot, node, low, windows): per repeated anchor the hashes of its consecutive windows from word ``low`` on
    that lie in no compacted span."""

    def run(batches):
        for batch in batches:
            d = batch.column(0)
            data, offsets = W.text_buffers(batch.column(2))
            for a, b in W.runs_of_rows(offsets):
                r = Run(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], window, k)
                if not len(r.row):
                    continue
                found = Nodes(batch.column(3), r.firsts, a, b, k, window)
                repeated, hot = np.zeros(len(r.words), dtype=bool), np.zeros(len(r.words), dtype=bool)
                repeated[found.at], hot[found.at] = True, found.hot
                inside = _covered(len(r.words), found.starts, found.ends - window + 1)
                pick = np.flatnonzero(repeated[r.anchor] & ~inside[r.at])
                if not len(pick):
                    continue
                at, anchor, row = r.at[pick], r.anchor[pick], r.row[pick]
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
                hashes = W.hash_spans(r.words, at, at + window).view(np.int64)
                source = pa.array(row[first] + a)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays(
                    [d.take(source), pa.array(hot[anchor[first]]), pa.array(r.nodes[anchor[first]].view(np.int64)),
                     pa.array((at[first] - r.firsts[row[first]]).astype(np.int32)), lists], ["d", "hot", "node", "low", "windows"])

    # The same columns of ``rows`` as in the last join, so that its shuffle of the texts is reused.
    joined = rows.join(nodes, "d").select("d", "doc_id", "text", "nodes")
    return joined.mapInArrow(run, "d binary, hot boolean, node long, low int, windows array<long>")


def repeated_windows(asked: DataFrame) -> DataFrame:
    """(d, windows): start words of the windows of ``asked`` that occur at least twice.

    Windows of one node meet in one partition and are counted there. Those of hot nodes, which might fill
    a task, are counted before and after the shuffle, and the counts are joined back.
    """
    flat = ["d", "node", (F.col("low") + F.col("j")).alias("at"), "w"]
    cold = asked.filter("not hot").repartition("node").select("d", "node", "low", F.posexplode("windows").alias("j", "w")).select(*flat)
    counted = cold.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node", "w"))).filter("n > 1")
    per_node = counted.groupBy("node", "d").agg(F.collect_set("at").alias("at"))
    hot = asked.filter("hot").select("d", "node", "low", F.posexplode("windows").alias("j", "w")).select(*flat)
    twice = hot.groupBy("node", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", "w")
    again = hot.join(twice, ["node", "w"]).groupBy("node", "d").agg(F.collect_set("at").alias("at"))
    return per_node.union(again).groupBy("d").agg(F.flatten(F.collect_list("at")).alias("windows"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` consecutive words of its document covers it whose word sequence also
    starts anywhere else in the table, the same document included. Windows are judged on the input. Words are
    runs of bytes other than space and 0x09-0x0D, compared as they are; kept words are joined by one space.
    A null or empty text has no words; a text shorter than the window keeps all; repeated rows count as
    documents of their own; a null ``doc_id`` stays null; other columns are ignored.
    """
    k = max(1, min(8, window // 2))
    rows = keyed(docs)
    nodes = reliable(repeated_nodes(rows, window, k), "nodes")
    again = repeated_windows(open_windows(rows, nodes, window, k))

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            data, offsets = W.text_buffers(batch.column(2))
            for a, b in W.runs_of_rows(offsets):
                part = data[offsets[a]:offsets[b]]
                starts, ends, firsts = W.find_words(part, offsets[a:b + 1] - offsets[a])
                found = Nodes(batch.column(3), firsts, a, b, k, window)
                at = _ints(batch.column(4), firsts, a, b)
                gone = _covered(len(starts), np.concatenate([found.starts, at]), np.concatenate([found.ends, at + window]))
                n = np.diff(firsts)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[firsts])
                texts = []
                raw = part.tobytes()
                for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                    keep = np.flatnonzero(~gone[i:j]) + i
                    texts.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])

    whole = rows.join(nodes, "d", "left").join(again, "d", "left").select("d", "doc_id", "text", "nodes", "windows")
    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
