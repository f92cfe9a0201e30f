"""Ranked lexical search against a plain restatement over all documents, and its masks."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from watchfold.llm import queries, ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=20):
    """Every document scored for every item."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in found if c]
    n_docs, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(queries.ranked_search(spark, sf)) == plain(docs, items)


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES["op13_ranked_search"])
    assert [c[0] for c in cursor.description] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(cursor.fetchall(), key=repr) == rows(queries.ranked_search(spark, sf))


@pytest.fixture
def odd():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)] + ["Über", "naïve", "中文", "x9y", "A", "the", "the", "the"]
    docs = [(i // 2 if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(7, "twice the same"), (7, "twice the same"), (900, None), (901, ""), (902, "-- !"), (903, "long " * 20000 + "w1"),
             (904, "ÜBER über w1 W1_w1"), (905, "the\x00the")]
    items = [(1, "the W1 w2 w2"), (2, None), (3, ""), (4, "absent words only zzzz"), (5, " ".join(words)), (5, "w1 again"),
             (None, "w3 über ÜBER"), (6, "twice same"), (7, " ".join(f"w{i}" for i in range(90)) + " the" * 40)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 3, 1) for i, t in docs], "doc_id long, text string, item_id string, rank int, score long"),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string"))


@pytest.mark.parametrize("pairs, cells", [(1 << 16, 1 << 23), (40, 700)])
def test_odd_rows_blocks_of_items_and_of_documents(spark, odd, monkeypatch, pairs, cells):
    monkeypatch.setattr(ranked, "PAIRS", pairs)
    monkeypatch.setattr(ranked, "CELLS", cells)
    docs, items = odd
    assert rows(ranked.rank(*frames(spark, docs, items), k=5)) == plain(docs, items, 5)


def test_empty_tables(spark, odd):
    docs, items = frames(spark, *odd)
    assert rows(ranked.rank(docs.limit(0), items)) == []
    assert rows(ranked.rank(docs, items.limit(0))) == []


def test_many_equal_scores(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(i, "other") for i in range(1000, 1600)]
    assert [r[2] for r in sorted(rows(ranked.rank(*frames(spark, docs, [(1, "same here")]), k=20)), key=lambda r: r[1])] == list(range(1, 21))


def test_masks_tell_documents_apart():
    rng = np.random.default_rng(1)
    for terms in (1, 8, 63, 64, 65, 200):
        bitmaps = rng.random((terms, 300)) < 0.02
        held, group = ranked.masks_of(bitmaps)
        assert (held[group] == bitmaps.T).all()
        assert len({tuple(m) for m in held.tolist()}) == len(held)


def test_groups_out_of_reach_are_not_scored(spark):
    """Scoring stops early, with the same result."""
    items = ranked.Items(ids=[1], numbers=[np.arange(3)], times=[np.ones(3, dtype=np.int64)], terms=[b"a", b"b", b"c"])
    docs = 20_000
    row = np.concatenate([np.arange(docs), np.arange(100)])
    term = np.concatenate([np.zeros(docs, dtype=np.int64), np.full(100, 2)])
    best = [ranked.Best(20)]
    scored = ranked.rank_block(items, np.array([10, 500, 5000]), best, np.arange(docs), np.zeros(docs, dtype=bool),
                               np.full(docs, 100), row, term, np.ones(len(row), dtype=np.int64))
    assert scored <= 200
    assert best[0].doc.tolist() == list(range(20))


def test_words_with_equal_hashes_do_not_count(monkeypatch):
    finder = ranked.Finder([b"abc", b"de"])
    real = ranked.W.hash_words
    monkeypatch.setattr(ranked.W, "hash_words", lambda data, s, e, lower=False: np.full(len(s), finder.hashes[0]) if lower else real(data, s, e))
    first = [b"abc", b"de"][finder.order[0]]
    data = np.frombuffer(b"xyz " + first + b" pq", dtype=np.uint8)
    n, row, term = finder.find(data, np.array([0, len(data)]))
    assert n.tolist() == [3] and row.tolist() == [0] and term.tolist() == [finder.order[0]]
