"""Source divergence against DuckDB and a plain restatement, with several vocabulary blocks, tiles and ranges."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from watchfold.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, least=10, top=10):
    read = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in read}:
        df = Counter(t for x, _, c in read if x == lang for t in c)
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for x, source, c in read:
            if x == lang:
                counts[source].update({t: c[t] for t in kept if t in c})
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for r, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, r))
    return sorted(out)


def rows(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_and_sql(spark, sf):
    got = rows(queries.source_divergence(spark, sf))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op12_source_divergence"])
    assert [c[0] for c in cursor.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert got == sorted(cursor.fetchall())
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()])


@pytest.fixture
def odd(spark):
    rng = random.Random(8)
    words = ["Über", "über", "ÉTÉ", "été", "中文", "a1b", "x-y", "it's", "A", "the"] + [f"{a}{b}" for a in "pqrst" for b in "uvwxyz"]
    docs = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", "", None, "fr x/=%", "en\n"])
        source = rng.choice(["s1", "s2", None, "", "s é", "S1"] + [f"n{j}" for j in range(9)])
        bias = hash_of(source)
        text = rng.choice([None, ""] + [" ".join(rng.choice(words[bias:]) for _ in range(rng.randrange(30))) for _ in range(20)])
        docs.append((text, lang, source))
    docs += [("only once here", "xx", "s1"), ("only once here", "xx", "s1"), (None, "yy", "s1"), (None, "yy", "s2"), (None, "yy", None),
             ("word " * 30000, "en", "s1"), ("tab\tin\x0bbetween\x7f\x00nul", "en", "s2")]
    return docs


def hash_of(source):
    return len(source or "") * 3


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "t", 1) for i, d in enumerate(docs)],
                                 "doc_id long, text string, lang string, source string, term string, block int")


@pytest.mark.parametrize("most, wide, tile", [(1 << 22, 4096, 64), (20, 7, 4)])
def test_odd_rows(spark, odd, monkeypatch, most, wide, tile):
    monkeypatch.setattr(divergence, "RANGE", wide)
    monkeypatch.setattr(divergence, "TILE", tile)
    assert rows(divergence.audit(frame(spark, odd), least_documents=3, top_terms=4, most_terms=most)) == plain(odd, 3, 4)


def test_empty_table_and_tables_without_terms(spark):
    assert rows(divergence.audit(frame(spark, [("a", "en", "s")]).limit(0))) == []
    bare = [(None, "en", "s1"), ("", "en", "s2"), ("12 34", "en", None)]
    assert rows(divergence.audit(frame(spark, bare))) == plain(bare)


def test_blocks_keep_every_occurrence(spark, odd):
    rows = divergence.prefixed_terms(frame(spark, odd))
    dealt = divergence.dealt_to_blocks(rows, 5)
    count = lambda df: Counter((r.lang, r.source, t) for r in df.collect() for t in r.terms)
    assert count(dealt) == count(rows)
    of = defaultdict(set)
    for r in dealt.collect():
        for t in r.terms:
            of[t].add(r.block)
    assert all(len(b) == 1 for b in of.values())


def test_shares_beyond_64_bits(spark):
    """Counts whose scaled value needs more than 64 bits are divided exactly too."""
    counts = [0, 1, 9_223_372_034, 9_223_372_035, 10**15, 3 * 10**17]
    rows = spark.createDataFrame([(c, 4 * 10**17, 10**6) for c in counts], "n long, total long, v long")
    got = rows.select("n", divergence._share(divergence.F.col("n"), divergence.F.col("total"), divergence.F.col("v")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {c: 1 + 10**9 * (c + 2) // (4 * 10**17 + 2 * 10**6) for c in counts}
