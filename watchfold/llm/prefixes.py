"""Exact token counts at every prefix of a text.

A text falls into segments across which the vocabulary never merges. The count at a prefix obeys a recurrence:
it is the count at the last segment boundary plus the tokens of the open segment's part. The boundary values
are stored once per text; truncation and budget questions then read them, and at most one short segment is
looked at again, never the text before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfold.llm import tokens as T


def prefix_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_bytes, ends, counts) of every row of ``docs`` (doc_id, text).

    ``ends`` are the byte positions at which segments end, ``counts`` the exact number of tokens of the text up
    to there, as `sentencepiece` gives it without begin and end tokens. Null and empty texts have no segments.
    Texts of any length, repeated rows and null ids are rows like others; other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches):
        counter = T.piece_counts(vocabulary)
        for batch in batches:
            for a, b, data, offsets in T.column_runs(batch.column(1)):
                ends, tokens, firsts = counter.segments(data, offsets)
                row = np.repeat(np.arange(b - a), np.diff(firsts))
                total = np.cumsum(tokens)
                before = np.concatenate([[0], total])[firsts[:-1]]
                ends, counts = ends - offsets[row], total - before[row]
                marked = counter.marked_rows(data, offsets)
                if len(marked):  # one segment each
                    texts = [data[offsets[r]:offsets[r + 1]].tobytes().decode() for r in marked]
                    other = ~np.isin(row, marked)
                    row = np.concatenate([row[other], marked])
                    ends = np.concatenate([ends[other], np.diff(offsets)[marked]])
                    counts = np.concatenate([counts[other], counter.count_texts(texts)])
                    order = np.argsort(row, kind="stable")
                    row, ends, counts = row[order], ends[order], counts[order]
                at = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), *lists],
                                                 ["doc_id", "n_bytes", "ends", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, ends array<int>, counts array<int>")


def total(counts: str = "counts") -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def longest_prefixes(texts: DataFrame, prefixes: DataFrame, budget: int, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, prefix_bytes, prefix_tokens): the longest prefix of whole characters with at most ``budget`` tokens.

    ``texts`` (doc_id, text) and ``prefixes`` of the same rows are joined by ``doc_id``, which is to be unique
    and not null. Only the segment in which the budget runs out is encoded, prefix by prefix.
    """

    def run(batches):
        counter = T.piece_counts(vocabulary)
        for batch in batches:
            out = []
            for doc, text, ends, counts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                raw, ends, counts = (text or "").encode(), ends or [], counts or []
                j = int(np.searchsorted(counts, budget, side="right"))
                end, tokens = (ends[j - 1], counts[j - 1]) if j else (0, 0)
                if j < len(ends):
                    segment = raw[end:ends[j]].decode()
                    for stop in range(len(segment) - 1, 0, -1):
                        n = counter.count_segment(segment[:stop], j == 0)
                        if tokens + n <= budget:
                            end, tokens = end + len(segment[:stop].encode()), tokens + n
                            break
                out.append((doc, end, tokens))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                                             ["doc_id", "prefix_bytes", "prefix_tokens"])

    joined = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        prefixes.select("doc_id", "ends", "counts"), "doc_id")
    return joined.select("doc_id", "text", "ends", "counts").mapInArrow(run, "doc_id long, prefix_bytes long, prefix_tokens long")
