"""Operators on documents against brute force, with null, empty, long and repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.llm import minhash, mixing, packing, pii, prefixes, quality, repeats
from watchfold.llm import tokens as T
from watchfold.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def made(seed, count, letters="abcdefgh", longest=120):
    draw = random.Random(seed)
    return [" ".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 9, 40, longest]))) for _ in range(count)]


# --- components -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_end_with_the_round_that_leaves_stars(spark, monkeypatch):
    """Rounds are many small tasks whose records the driver keeps: none is run to see that nothing changes."""
    from watchfold.llm import components as c
    tables, write = [], c.reliable
    monkeypatch.setattr(c, "reliable", lambda df, name: tables.append(df) or write(df, name))
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 3), (None, 1), (8, 7)], "a long, b long")
    assert sorted(map(tuple, components(path).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert len(tables) == 2 and tables[-1]._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 5
    edges = lambda *rows: spark.createDataFrame(rows, "hi long, lo long")
    assert c._stars(edges((2, 1), (3, 1), (5, 4))) and c._stars(edges((2, 1)).limit(0))
    assert not c._stars(edges((2, 1), (3, 2))) and not c._stars(edges((3, 1), (3, 2)))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates ------------------------------------------------------------------------------------

def shingles(text, width):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked_components(pairs, width, similarity=80):
    sets, root = {i: shingles(t, width) for i, t in pairs}, {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited_family(seed, count, base_words=60, edits=4):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(base_words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(draw.randrange(edits)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates(texts):
    family = edited_family(3, 40) + edited_family(4, 25, 30, 3)
    pairs = list(enumerate([None, "", " \n ", "one", "One", "ONE two", "one two three", "ÉA b c d e f", *family, family[0]], start=1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(texts(*pairs), width=4).collect()}
    assert got == linked_components(pairs, 4)


def test_near_duplicates_keep_one_of_each(texts):
    pairs = list(enumerate(edited_family(9, 12, 200, 2)))
    rows = minhash.near_duplicates(texts(*pairs)).collect()
    expected = linked_components(pairs, 5)
    assert {r.doc_id for r in rows if r.kept} == {c for _, c in expected.values()}


def test_near_duplicates_of_repeated_and_null_ids(texts):
    """Id 1 has two texts with a neighbour each, id 2 stands twice with one text; null ids link like others."""
    one, two, three = ([t, t + " more"] for t in edited_family(21, 1) + edited_family(22, 1) + edited_family(23, 1))
    rows = [(1, one[0]), (1, two[0]), (3, one[1]), (4, two[1]), (None, one[0]), (2, "a b c d e f"), (2, "a b c d e f"),
            (None, three[0]), (None, three[1]), (None, None), (5, "")]
    numbered = list(enumerate((t for _, t in rows)))
    root = {i: c for i, (_, c) in linked_components(numbered, 5).items()}
    got = minhash.near_duplicates(texts(*rows)).collect()
    expected = []
    for i, (own, text) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root[j] == root[i] and d is not None]
        expected.append((own, len(shingles(text, 5)), min(ids, default=None)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    left = sorted(repr((r.doc_id, r.text)) for r in minhash.keep_one(texts(*rows)).collect())
    third = min(three, key=lambda t: hashlib.md5(f":{t}".encode()).digest())
    assert left == sorted(map(repr, [(1, one[0]), (1, two[0]), (2, "a b c d e f"), (None, third), (None, None), (5, "")]))
    assert minhash.keep_one(texts()).count() == 0


def test_near_duplicates_of_nothing(texts):
    assert minhash.near_duplicates(texts()).count() == 0


def test_signatures_agree_like_the_sets():
    draw = np.random.default_rng(5)
    same = 0
    for _ in range(40):
        values = draw.integers(0, 1 << 62, 125).astype(np.uint64)
        keys = minhash.band_keys([values[:113], values[12:]], 200, 1)
        same += (keys[0] == keys[1]).mean()
    assert abs(same / 40 - 101 / 125) < 0.03


def test_densify_fills_every_bin_of_a_sparse_row():
    bins = np.full((3, 80), minhash.EMPTY, dtype=np.uint64)
    bins[0, 7] = 3
    bins[1, [1, 70]] = [4, 5]
    full = minhash.densify(bins)
    assert set(full[0]) == {3} and set(full[1]) == {4, 5} and set(full[2]) == {minhash.EMPTY}


# --- repeated passages ----------------------------------------------------------------------------------

def without_repeats(pairs, window):
    words = [(i, WORDS.findall(t or "")) for i, t in pairs]
    seen = Counter(tuple(w[j:j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters,window,hot", [("ab", 10, 10 ** 6), ("abcdefgh", 9, 10 ** 6), ("abc", 7, 3)])
def test_repeats(texts, letters, window, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    base = made(1, 1, "abcdefghij", 80)[0] or "a b c d e f g h i j k l"
    pairs = list(enumerate(made(2, 40, letters))) + [(90, base), (91, base), (91, base), (92, base + " z " + base), (93, None),
                                                      (94, ""), (95, "x " * 90), (96, "äö € " * 30), (None, base)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(texts(*pairs), window).collect()), key=repr)
    assert got == without_repeats(pairs, window)


def test_repeats_of_test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(docs, 35).collect()}
    expected = without_repeats([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert got == {i: rest for i, *rest in map(lambda e: (e[0], *e[1:]), expected)} or got == {e[0]: tuple(e[1:]) for e in expected}


def test_repeats_keep_texts_of_equal_short_hashes_apart(spark, texts):
    """Two texts that Spark's 32-bit hash does not tell apart, without ids; the second is unique."""
    seen, draw = {}, random.Random(8)
    pool = [" ".join(f"w{draw.randrange(10 ** 9)}" for _ in range(12)) for _ in range(200_000)]
    for h, text in zip((r[0] for r in spark.createDataFrame([(t,) for t in pool], "t string").select(F.hash("t")).collect()), pool):
        if h in seen:
            break
        seen[h] = text
    pairs = [(None, seen[h]), (None, seen[h]), (None, text), (-1, "x " * 3), (None, "x " * 3)]
    assert seen[h] != text
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(texts(*pairs), 8).collect()), key=repr)
    assert got == without_repeats(pairs, 8)


def test_repeats_of_nothing(texts):
    assert repeats.remove_repeats(texts(), 35).count() == 0


# --- personal data --------------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    forms = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (form, ok) in enumerate(forms) for m in re.finditer(form, text or "") if ok(m[0]))


ODD = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111",
       "+1 (555) 123-4567. +1-+2 333 444 5555", "\x01\x02 é \U0001f600 a.b@c.d..e @x.y a@@b.c", "12" * 5000, "a@" + "b.c" * 3000,
       "x" * 20000 + "@", "1 " * 3000, None, "", ". a@b.co, 411111111111111111111 5500005555555559", "q@-.-a 1.2.3.4@5.6 "]


def test_pii_base_spans(texts):
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found if s.base] for r in pii.find_pii(texts(*enumerate(ODD))).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(ODD)}


def test_pii_base_spans_of_test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert [(s.start, s.kind, s.end) for s in r.found if s.base] == base_spans(source[r.doc_id])


def test_trees_add_spans_that_look_like_base_spans():
    card, other = (2, 16, 4, 0, 0, 0, 0, 0, 1, 1, 0), (2, 8, 2, 0, 0, 0, 0, 0, 1, 1, 0)
    trees = pii.Trees([(card, 2000, 3), (other, 0, 900)])
    assert trees.thresholds[2] < float("inf") and trees.thresholds[0] == float("inf")


def test_trees_select_by_margin(spark):
    card, other = (2, 16, 4, 0, 0, 0, 0, 0, 1, 1, 0), (2, 8, 2, 0, 0, 0, 0, 0, 1, 1, 0)
    trees = pii.Trees([(card, 2000, 3), (other, 0, 900)])
    rows = spark.createDataFrame([(2, list(card)), (2, list(other))], "kind int, features array<int>")
    assert [r[0] for r in rows.select(trees.selects(F.struct("kind", "features"))).collect()] == [True, False]


def test_redaction(texts):
    rows = pii.redact(texts((1, "mail a.b@c.de now"), (2, None), (3, ""), (4, "1.2.3.4 and +1 (555) 123-4567"), (5, "clean"))).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "mail [EMAIL] now", 2: None, 3: "", 4: "[IP] and [PHONE]", 5: "clean"}
    assert all((r.node, r.n, r.lang) == ("node", 1, "en") for r in rows)


def test_pii_of_nothing(texts):
    assert pii.find_pii(texts()).count() == 0 and pii.redact(texts()).count() == 0


# --- quality --------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert all(0 <= s <= 1 for s in good + bad)
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_without_labels(spark, texts):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(texts((1, None), (2, ""), (None, "x"), (2, "w " * 20000)), labels).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert quality.classify(texts(), labels).count() == 0
    assert quality.keep_good(texts((1, None), (None, "x")), labels).count() == 2


def test_gradients():
    draw = np.random.default_rng(1)
    model, x, counts, y = quality.Attention(5, 4, 3), draw.standard_normal((9, 5)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, counts)["score"]) + (1 - y) * np.log(1 - s))
    for name, g in model.gradients(x, counts, y).items():
        at = (0,) * g.ndim
        model.p[name][at] += 1e-6
        high = loss()
        model.p[name][at] -= 2e-6
        low = loss()
        model.p[name][at] += 1e-6
        assert abs((high - low) / 2e-6 - g[at]) < 1e-6


# --- tokens ---------------------------------------------------------------------------------------------

TRICKY = ["", None, " ", "\n a", "a  b", "İstanbul ΑΣ", "x<|endoftext|>y ok", "don't I'LL  we're'", "\x01\x02 q",
          "é é ﬁ ½ 東京", "\t\t", "a \n b  \n\n  c", "▁a ▁ b", "a▁ b", "\r\n x;\r\n", "   lead",
          "trail   ", "1234 a1b2", "'s's't!!'d", "Ǆ ŉ ſ", "</s> a <s>b", "word " * 30000]


def test_prefix_counts(texts):
    counter = T.piece_counts("piece_bpe_32k.model")
    pairs = list(enumerate(TRICKY)) + [(i + 100, t) for i, t in enumerate(made(8, 20))]
    rows = prefixes.prefix_counts(texts(*pairs)).select("doc_id", "n_bytes", prefixes.total().alias("n"), "ends", "counts").collect()
    for r in rows:
        text = dict(pairs)[r.doc_id] or ""
        assert (r.n_bytes, r.n) == (len(text.encode()), len(counter.model.encode(text)))
        for end, count in list(zip(r.ends, r.counts))[:40]:
            assert len(counter.model.encode(text.encode()[:end].decode())) == count
    assert prefixes.prefix_counts(texts()).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 3, 8])
def test_longest_prefixes(texts, budget):
    model = T.piece_counts("piece_bpe_32k.model").model
    pairs = [(1, "Hello wörld\n\n  foo;\r\n  bar baz qux"), (2, "a▁b  c"), (3, None), (4, " x"), (5, "unbelievable")]
    docs = texts(*pairs)
    got = {r.doc_id: (r.prefix_bytes, r.prefix_tokens) for r in prefixes.longest_prefixes(docs, prefixes.prefix_counts(docs), budget).collect()}
    for i, t in pairs:
        cuts = [(len((t or "")[:k].encode()), len(model.encode((t or "")[:k]))) for k in range(len(t or "") + 1)]
        assert got[i] == max(c for c in cuts if c[1] <= budget)


# --- packing --------------------------------------------------------------------------------------------

def check_pieces(rows, pairs, window):
    whole = T.word_ids("word_bpe_49k.json").whole
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in pairs}
    for i, t in pairs:
        ids, at = whole.encode(t or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window


def test_packing(texts):
    pairs = list(enumerate(TRICKY[:-1])) + [(500, "long words here " * 3000)] + [(i + 100, t) for i, t in enumerate(made(8, 60))]
    check_pieces(packing.pack(texts(*pairs), window=512, shard_tokens=4000).collect(), pairs, 512)
    assert packing.pack(texts()).count() == 0


def test_packing_prefers_lexical_neighbours():
    docs = [np.full(30, t, dtype=np.uint16) for t in (5, 9, 5, 9, 5, 9)]
    index = packing.Index(docs, np.ones(1 << 16, dtype=np.float32), 30)
    windows = {}
    for i, _, _, sequence, _ in packing.pack_shard(docs, index, 90):
        windows.setdefault(sequence, set()).add(i % 2)
    assert all(len(w) == 1 for s, w in windows.items() if s < 2)


def test_neighbours_are_scored_over_all_shared_terms():
    """Document 1 shares the 20 most telling terms of the seed, document 2 forty lesser ones, document 3 only the end id."""
    idf = np.ones(1 << 16, dtype=np.float32)
    idf[100:120] = 1.1
    docs = [np.array([*x, 2], dtype=np.uint16) for x in (range(100, 160), range(100, 120), range(120, 160), range(300, 320))]
    index, unused = packing.Index(docs, idf, 40, end=2), np.array([False, True, True, True])
    assert index.neighbours(docs[0], unused).tolist() == [2, 1]
    unused[2] = False
    assert index.neighbours(docs[0], unused).tolist() == [1] and not set(index.doc.tolist()) & {0, 2}


def test_gaps_are_filled_by_shared_terms_before_length():
    """A seed that runs out of neighbours is followed by the longest document and then that one's own neighbours."""
    docs = [np.full(n, t, dtype=np.uint16) for n, t in ((40, 5), (30, 9), (20, 7), (10, 9))]
    pieces = packing.pack_shard(docs, packing.Index(docs, np.ones(1 << 16, dtype=np.float32), 25), 80)
    assert [i for i, _, _, sequence, _ in pieces if sequence == 0] == [0, 1, 3]


def test_related_documents_meet_in_one_shard(texts):
    """Sixty topics of four documents, mixed: each topic's two words are its own, the rest is common to all."""
    whole, draw = T.word_ids("word_bpe_49k.json").whole, random.Random(6)
    words = [w for w in (whole.decode([i]).strip() for i in range(8000, 14000)) if w.isascii() and w.isalpha() and len(w) > 4]
    common, own = words[:40], words[40:160]
    pairs = [(10 * t + k, " ".join([*[own[2 * t], own[2 * t + 1]] * 8, *draw.choices(common, k=30)])) for t in range(60) for k in range(4)]
    rows = packing.pack(texts(*pairs), window=256, shard_tokens=1500).collect()
    shards = [{r.sequence_id >> 32 for r in rows if r.doc_id // 10 == t} for t in range(60)]
    assert len(set().union(*shards)) >= 8 and sum(len(s) == 1 for s in shards) >= 57
    check_pieces(rows, pairs, 256)


def test_a_hot_key_has_shards_of_its_own(texts):
    pairs = [(i, "the same few words again") for i in range(300)] + [(1000 + i, t) for i, t in enumerate(["", None, "solitary", *made(3, 20)])]
    rows = packing.pack(texts(*pairs), window=64, shard_tokens=2000).collect()
    check_pieces(rows, pairs, 64)
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(sizes) >= 8 and max(sizes.values()) <= 100


# --- mixing ---------------------------------------------------------------------------------------------

def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("d", "en", "b", 900), ("d", "fr", "c", 1000), ("e", "en", "f", 2000)],
                                   "domain string, lang string, source string, tokens long")
    ones = {c: F.lit(1) for c in mixing.LEVELS}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, ones, 0.5, 1).collect()}
    assert got == {"a": 100, "b": 400, "c": 500, "f": 1000}
    full = {r.source: r.budget for r in mixing.leaf_budgets(leaves, ones, 1.0, 1).collect()}
    assert full == {"a": 100, "b": 900, "c": 1000, "f": 2000}


def test_mix_takes_add_up_to_budgets(texts):
    pairs = [(i, t) for i, t in enumerate(made(4, 60))] + [(3, "again"), (3, "again"), (None, "a b"), (70, None)]
    docs = texts(*pairs)
    rows = mixing.select_mix(docs, F.lit(None).cast("string"), {c: F.lit(1) for c in mixing.LEVELS}, share=0.7, epochs=2).collect()
    words = sum(len(WORDS.findall(t or "")) for _, t in pairs)
    assert sum(r.take_tokens for r in rows) == int(words * 0.7)
    assert {r.domain for r in rows} == {"unknown"} and all(0 <= r.take_tokens <= r.n_tokens for r in rows)
    assert mixing.select_mix(texts(), F.lit("d"), {c: F.lit(1) for c in mixing.LEVELS}).count() == 0


@pytest.mark.parametrize("epochs,share", [(1, 0.7), (2, 1.4)])
def test_mixed_documents_are_cut_at_the_budget(texts, epochs, share):
    pairs = [(i, t) for i, t in enumerate(made(4, 60))] + [(3, " again  and\tagain "), (3, " again  and\tagain "), (None, "a b"), (None, "a b"), (70, None), (71, "")]
    docs, ones = texts(*pairs), {c: F.lit(1) for c in mixing.LEVELS}
    rows = mixing.mixed_documents(docs, F.lit("d"), ones, share, epochs).collect()
    count = lambda t: len(WORDS.findall(t or ""))
    assert sum(count(r.text) for r in rows) == int(sum(count(t) for _, t in pairs) * share)
    whole = Counter(pairs)
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert len(cut) <= 1
    for r in cut:
        assert any(i == r.doc_id and t.startswith(r.text) and not r.text[-1].isspace() for i, t in pairs)
    assert all(n <= epochs * whole[k] for k, n in Counter((r.doc_id, r.text) for r in rows if r not in cut).items())
    assert rows[0].__fields__ == docs.columns
    assert mixing.mixed_documents(texts(), F.lit("d"), ones, 0.8, 1).count() == 0


def test_mix_weight_zero_takes_nothing(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("e", "en", "b", 100)], "domain string, lang string, source string, tokens long")
    weights = {"domain": F.when(F.col("domain") == "d", 1).otherwise(0), "lang": F.lit(1), "source": F.lit(1)}
    assert [(r.source, r.budget) for r in mixing.leaf_budgets(leaves, weights, 0.5, 1).collect()] == [("a", 100)]


def test_digests(spark):
    from watchfold.llm import queries
    rows = queries.substring_dedup(spark, SMALL).collect()
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    expected = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in without_repeats(list(texts_.items()), 35)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == expected
