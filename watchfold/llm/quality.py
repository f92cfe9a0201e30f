"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (longer ones where it would have more than ``MOST``, so the
passages always cover the whole text). A passage is encoded from its spelling: shares of character kinds and
signs, word lengths, repetition, and a hashed bag of words. A small network learns an encoding of passages and
gated attention weights from document labels alone; the score is taken from the weighted sum of encodings.
It is trained on the driver from a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfold.llm import words as W

PASSAGE = 64
MOST = 64
HASHED = 32
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#", "&", "$", "*", "%", "|", "!", ".", ",", "?\"'();:-", "\n",
         "<>{}[]=/\\_@^~`+"]
FEATURES = len(KINDS) + 1 + 7 + HASHED


def _tables() -> np.ndarray:
    out = np.zeros((len(KINDS) + 1, 256), dtype=bool)
    for i, kind in enumerate(KINDS):
        out[i, [ord(c) for c in kind]] = True
    out[-1, 0x80:] = True
    return out


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a run of rows, and the number of passages per row (one at least)."""
    starts, ends, firsts = W.find_words(data, offsets)
    h = W.hash_words(data, starts, ends, lower=True)
    n = np.diff(firsts)
    width = np.maximum(PASSAGE, -(-n // MOST))
    counts = np.maximum(-(-n // width), 1)
    row = np.repeat(np.arange(len(n)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = firsts[row] + inner * width[row]
    high = np.minimum(low + width[row], firsts[row + 1])
    out = np.zeros((len(row), FEATURES), dtype=np.float32)
    full = np.flatnonzero(high > low)
    if not len(full):
        return out, counts
    lo, hi = low[full], high[full]
    words = (hi - lo).astype(np.float64)
    a, b = starts[lo], ends[hi - 1]
    size = (b - a).astype(np.float64)

    def shares(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype == bool else np.float64)])
        return sums[y] - sums[x]

    kinds = _tables()
    for i in range(len(kinds)):
        out[full, i] = shares(kinds[i][data], a, b) / size
    at = len(kinds)
    lens = (ends - starts).astype(np.float64)
    mean = shares(lens, lo, hi) / words
    out[full, at] = np.log1p(mean)
    out[full, at + 1] = np.log1p(np.sqrt(np.maximum(shares(lens ** 2, lo, hi) / words - mean ** 2, 0)))
    out[full, at + 2] = np.log1p(words)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    out[full, at + 3] = shares(same, np.minimum(lo + 1, hi), hi) / words
    owner = np.repeat(np.arange(len(full)), hi - lo)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[full, at + 4] = np.bincount(owner[order][fresh], minlength=len(full)) / words
    tails = data[ends - 1]
    letters = ((tails >= 0x61) & (tails <= 0x7A)) | ((tails >= 0x41) & (tails <= 0x5A)) | (tails >= 0x80)
    out[full, at + 5] = shares(letters, lo, hi) / words
    out[full, at + 6] = np.log1p(n[row[full]])
    slots = (W.mix(h) % np.uint64(HASHED)).astype(np.int64)
    bag = np.bincount(owner * HASHED + slots, minlength=len(full) * HASHED).reshape(-1, HASHED)
    out[full, at + 7:] = bag / words[:, None]
    return out, counts


class Attention:
    """tanh encoder, gated attention, logistic output; parameters are plain arrays."""

    def __init__(self, dim: int, hidden: int = 24, gate: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape) / np.sqrt(shape[0])

        self.centre, self.scale = np.zeros(dim), np.ones(dim)
        self.p = {"w": init(dim, hidden), "b": np.zeros(hidden), "v": init(hidden, gate), "vb": np.zeros(gate),
                  "u": init(hidden, gate), "ub": np.zeros(gate), "a": init(gate), "c": init(hidden), "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        """``x``: scaled passages in document order; ``counts``: passages per document, each 1 or more."""
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["w"] + p["b"])
        t = np.tanh(h @ p["v"] + p["vb"])
        g = 1 / (1 + np.exp(-(h @ p["u"] + p["ub"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        weight = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(weight[:, None] * h, first)
        logit = np.clip(z @ p["c"] + p["c0"], -40, 40)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-logit)), "first": first}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["weight"] * (da - np.repeat(np.add.reduceat(f["weight"] * da, f["first"]), counts))
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["weight"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dt, "vb": dt.sum(axis=0), "u": f["h"].T @ dg,
                "ub": dg.sum(axis=0), "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()])}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256,
            rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> None:
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.centre) / self.scale
        rng, first = np.random.default_rng(seed), np.cumsum(counts) - counts
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at:at + batch]
                n = counts[docs]
                rows = np.repeat(first[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
                step += 1
                for k, g in self.gradients(x[rows], n, y[docs]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.centre) / self.scale, counts)["score"]


def held_out(doc_id="doc_id"):
    """True for the fifth of the ids that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _encode(batches):
    for batch in batches:
        data, offsets = W.text_buffers(batch.column(2))
        for a, b in W.runs_of_rows(offsets):
            x, counts = passage_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            cuts = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                 pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 8192) -> Attention | None:
    """A model fitted on at most ``most`` labelled documents, or None without two kinds of labels.

    Rows whose id falls into the held-out fifth, without id or without label are not used; of several labels
    of one document the mean counts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("y").alias("y"))
    count = max(known.count(), 1)
    share = min(1.0, most / count)
    # The hash keeps about ``most`` ids before the limit, so no task gathers more; the limit proves the bound.
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id").select(
        "doc_id", "y", "text").mapInArrow(_encode, "doc_id long, y double, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    rows = rows[:most]
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    model = Attention(FEATURES)
    model.fit(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), y)
    return model


def scores(docs: DataFrame, model: Attention | None) -> DataFrame:
    """(doc_id, score) of every row; 0.5 throughout without a model."""

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            for a, b in W.runs_of_rows(offsets):
                x, counts = passage_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                s = np.full(b - a, 0.5) if model is None else model.score(x.astype(np.float64), counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8192) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Learned from ``labels`` (doc_id, quality) outside the held-out fifth of the ids. The score uses the text
    alone: null and empty texts are one passage without words. Without usable labels every score is 0.5.
    Repeated rows are scored alike; a null ``doc_id`` stays null and is never learned from; other columns are
    ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, most)
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8192) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns as they are; one pass, no shuffle."""
    model = train(docs, labels, most)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(at))
            for a, b in W.runs_of_rows(offsets):
                x, counts = passage_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                s = np.full(b - a, 0.5) if model is None else model.score(x.astype(np.float64), counts)
                yield batch.slice(a, b - a).filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
