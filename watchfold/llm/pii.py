"""Personal data in texts: candidate spans, boosted trees, calibrated thresholds; Spark expressions only.

Generators propose spans per kind. The base forms (see ``KINDS``) are always redacted. Loose forms propose more
spans, which may overlap; boosted trees score every candidate from its form and its surroundings. The trees
learn what base spans look like without seeing the checks that make a span a base span. A loose span is taken if
its score reaches the threshold of its kind, above which at most ``1 - PRECISION`` of the candidates were not base
spans. Training counts candidates of the whole table by their features; the trees are fitted on those counts.

Positions come from ``split`` and ``regexp_extract_all`` over the same pattern. Patterns use no repeated groups: marks
that belong between two characters are first written as control characters of the same length, so that long
runs neither nest nor backtrack.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfold.session import reliable

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.995
CHUNK = 256
NEAR = 16
DOT, GAP, OTHER = "\x02", "\x01", "\x03"
# Base forms after the rewriting of `_between`: DOT is a dot before a domain character, GAP a space or hyphen
# between two digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\x02-])|\G)[A-Za-z0-9._%+\x02-]+@[A-Za-z0-9-]+\x02[A-Za-z0-9\x02-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9\x01])[0-9\x01]{12,37}(?![0-9\x01])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose forms: an address without a full domain, dotted or colon numbers, digit groups, national phone numbers.
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]{1,62}"
LOOSE_NUMBER = r"(?<![A-Za-z0-9])[(+]?[0-9][0-9().\x20\x2D/]{6,40}[0-9](?![A-Za-z0-9])"
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,features:array<int>>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; expressions named inside a lambda would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Sums of all elements up to each one. Chunks keep the work linear in the length for any real text."""
    zero = F.lit(0)

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def chunked(v: Column) -> Column:
        count = F.greatest(F.ceil(F.size(v) / F.lit(CHUNK)).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(v, (i - 1) * CHUNK + 1, CHUNK))

    def joined(chunks: Column) -> Column:
        inner = F.transform(chunks, sums)
        return let(sums(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))), lambda low: F.flatten(
            F.transform(inner, lambda c, i: F.transform(F.slice(c, 2, CHUNK), lambda x: x + F.get(low, i)))))

    return let(values, lambda v: let(chunked(v), joined))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, part, before, after>> of all matches, starts in code points from 0."""
    none = F.array().cast("array<struct<start:int,part:string,before:string,after:string>>")

    def placed(s: Column) -> Column:
        parts, gaps = s["parts"], s["gaps"]
        lengths = F.transform(parts, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(running(lengths), lambda ends: F.transform(parts, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), m.alias("part"), F.right(F.get(gaps, i), F.lit(NEAR)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("after"))))

    def searched(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda parts: F.when(
            F.size(parts) > 0, let(F.struct(parts.alias("parts"), F.split(t, pattern, -1).alias("gaps")), placed)).otherwise(none))

    return let(text, searched)


def _digits(part: Column) -> Column:
    return F.regexp_replace(part, "[^0-9]", "")


def _features(kind: Column, m: Column) -> Column:
    """Form and surroundings of a candidate as small numbers; none of the checks of the base forms."""
    part, digits = m["part"], F.length(_digits(m["part"]))
    marks = F.length(F.regexp_replace(part, r"[A-Za-z0-9\x20]", ""))
    return F.array(
        kind, F.least(digits, F.lit(24)), F.least(F.length(part), F.lit(40)) / 4, F.least(marks, F.lit(6)),
        F.least(F.length(F.regexp_replace(part, r"[^.\x02]", "")), F.lit(4)),
        F.least(F.length(F.regexp_replace(part, r"[^\x20\x01-]", "")), F.lit(4)),
        F.when(part.startswith("+"), 1).otherwise(0), F.when(part.contains("("), 1).otherwise(0),
        F.when(m["before"].rlike(r"[A-Za-z0-9]$"), 2).when(m["before"].rlike(r"[\x20\n\t]$"), 1).otherwise(0),
        F.when(m["after"].rlike(r"^[A-Za-z0-9]"), 2).when(m["after"].rlike(r"^[\x20\n\t]"), 1).otherwise(0),
        F.when(F.lower(m["before"]).rlike(r"(tel|phone|call|mail|card|addr|from|ip)[a-z]*[^a-z]*$"), 1).otherwise(0),
    ).cast("array<int>")


FEATURES = 11


def _cast(items: Column) -> Column:
    return items.cast(SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text: base spans per kind, leftmost and without overlap, and loose ones."""
    octet = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"

    def proper(kind: int, m: Column) -> Column:
        if kind == 1:
            return F.forall(F.split(m["part"], r"\."), lambda p: p.rlike(octet))
        if kind == 2:
            return let(_digits(m["part"]), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
        if kind == 3:
            return F.length(_digits(m["part"])).between(9, 15)
        return F.lit(True)

    def spans(kind: int, asked: Column, source: Column, pattern: str, base: bool) -> Column:
        described_ = F.transform(found(source, pattern), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["part"])).alias("end"),
            (proper(kind, m) if base else F.lit(False)).alias("base"), _features(F.lit(kind), m).alias("features")))
        return F.when(asked, described_.cast(SPAN)).otherwise(F.array().cast(SPAN))

    def proposed(t: Column) -> Column:
        mail, number = t.contains("@"), t.rlike("[0-9]")
        dotted = F.regexp_replace(t, r"\.(?=[A-Za-z0-9-])", DOT)
        gapped = F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
        # A base match that fails its check stays a candidate for the trees.
        return F.concat(
            spans(0, mail, dotted, EMAIL, True), spans(1, number, t, IP, True), spans(2, number, gapped, CARD, True),
            spans(3, t.contains("+"), t, PHONE, True), spans(0, mail, t, LOOSE_EMAIL, False),
            spans(2, number, t, LOOSE_NUMBER, False), spans(3, number, t, LOOSE_NUMBER, False))

    return let(F.translate(text, GAP + DOT, OTHER + OTHER), proposed)


def loose_only(spans: Column) -> Column:
    """Candidates that are no base spans and touch no base span of any kind."""
    touches = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    return let(F.filter(spans, lambda s: s["base"]), lambda base: F.filter(
        spans, lambda s: ~s["base"] & ~F.exists(base, lambda b: touches(s, b))))


class Trees:
    """Gradient-boosted trees of depth 2 over counted feature cells, with a threshold per kind."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]], rounds: int = 24, rate: float = 0.4):
        """``cells``: (features, base spans, others)."""
        self.trees: list[tuple] = []
        good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
        self.bias = math.log((good + 1) / (bad + 1))
        margin = [self.bias] * len(cells)
        for _ in range(rounds if good and bad else 0):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            g = [c[1] * (1 - q) - c[2] * q for c, q in zip(cells, p)]
            h = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p)]
            top = self._split(cells, range(len(cells)), g, h)
            if top is None:
                break
            f, cut = top
            tree = [f, cut]
            for side in (True, False):
                rows = [i for i, c in enumerate(cells) if (c[0][f] <= cut) == side]
                below = self._split(cells, rows, g, h) or (f, cut)
                leaves = []
                for part in (True, False):
                    at = [i for i in rows if (cells[i][0][below[0]] <= below[1]) == part]
                    value = rate * sum(g[i] for i in at) / (sum(h[i] for i in at) + 1.0)
                    leaves.append(value)
                    for i in at:
                        margin[i] += value
                tree.append((*below, *leaves))
            self.trees.append(tuple(tree))
        self.thresholds = []
        for kind in range(len(KINDS)):
            own = sorted(((m, c[1], c[2]) for m, c in zip(margin, cells) if c[0][0] == kind), reverse=True)
            best, right, wrong = math.inf, 0, 0
            for i, (m, a, b) in enumerate(own):
                right, wrong = right + a, wrong + b
                if (i + 1 == len(own) or own[i + 1][0] < m) and right >= PRECISION * (right + wrong):
                    best = m
            self.thresholds.append(best)

    @staticmethod
    def _split(cells, rows, g, h):
        best, choice = 1e-9, None
        rows = list(rows)
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in range(FEATURES):
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            a = b = 0.0
            for value in sorted(sums)[:-1]:
                a, b = a + sums[value][0], b + sums[value][1]
                gain = a * a / (b + 1) + (sg - a) ** 2 / (sh - b + 1) - sg * sg / (sh + 1)
                if gain > best:
                    best, choice = gain, (f, value)
        return choice

    def margin(self, features: Column) -> Column:
        def leaf(side: tuple) -> Column:
            f, cut, low, high = side
            return F.when(F.get(features, F.lit(f)) <= cut, F.lit(low)).otherwise(F.lit(high))

        values = [F.when(F.get(features, F.lit(t[0])) <= t[1], leaf(t[2])).otherwise(leaf(t[3])) for t in self.trees]
        return reduce(lambda a, b: a + b, values, F.lit(self.bias))

    def selects(self, span: Column) -> Column:
        limit = F.element_at(F.array(*[F.lit(float(min(t, 1e300))) for t in self.thresholds]), span["kind"] + 1)
        return self.margin(span["features"]) >= limit


def fit(rows: DataFrame) -> Trees:
    """Trees from the candidates of all rows (``spans``), counted by features; the cells are bounded by their ranges."""
    kept = F.concat(F.filter("spans", lambda s: s["base"]), loose_only(F.col("spans")))
    cells = (rows.filter(F.size("spans") > 0).select(F.explode(kept).alias("s")).groupBy("s.features").agg(
        F.sum(F.col("s.base").cast("long")).alias("good"), F.sum((~F.col("s.base")).cast("long")).alias("bad")).collect())
    return Trees(sorted((tuple(c["features"]), c["good"], c["bad"]) for c in cells))


def with_candidates(docs: DataFrame) -> DataFrame:
    """The rows with ``spans``, written once, so that texts are searched once."""
    return reliable(docs.withColumn("spans", candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))), "candidates")


def taken(trees: Trees) -> Column:
    """array<struct<start, kind, end, base>> of the spans to redact, by start, then kind, then end, without repeats."""
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter(loose_only(F.col("spans")), trees.selects)
    return F.array_sort(F.array_distinct(F.transform(F.concat(base, more), lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"]))))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of every row of ``docs`` (doc_id, text); ``found`` as in `taken`.

    Base spans: leftmost matches of the four forms that pass the checks of their kind, without retries. Further
    spans are those that the trees select. Null and empty texts have none. Repeated rows are alike; a null
    ``doc_id`` stays null; other columns are ignored; an empty table gives an empty result.
    """
    rows = with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "spans")
    return rows.select("doc_id", taken(fit(rows)).alias("found"))


def described(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every taken span of ``text`` replaced by [KIND]; overlapping spans become one, named by the
    first. Other columns and null texts stay as they are; ``n_chars``, if there is one, follows the new text."""
    rows = docs.withColumn("spans", candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    counted = reliable(rows.select("spans"), "candidates")
    trees = fit(counted)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def grown(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), F.array_append(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["start"].alias("start"), last["kind"].alias("kind"),
                                                             F.greatest(last["end"], s["end"]).alias("end")))).otherwise(
            F.array_append(acc, F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def replaced(merged: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0)
        pieces = F.transform(merged, lambda s, i: F.concat(
            F.substr(text, before(i) + 1, s["start"] - before(i)), F.element_at(names, s["kind"] + 1)))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(merged, -1)["end"] + 1, F.length(text)))

    new = let(F.aggregate(taken(trees), empty, grown), lambda merged: F.when(F.size(merged) > 0, replaced(merged)).otherwise(text))
    out = rows.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
