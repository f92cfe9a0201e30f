"""Mixing of sources to target weights: a budget flows down a tree of domains, languages and sources.

At every node the children share its budget by weight; a child that cannot use its share (its tokens times the
allowed epochs) takes what it has, and the rest goes to its siblings by weight before anything is left to
ancestors. A leaf then takes its prefix of a seeded order of its documents, epoch after epoch. Leaves are a small
table; documents are ordered inside (leaf, epoch, slot of the hash), so a leaf with most rows is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchfold.session import reliable

LEVELS = ["domain", "lang", "source"]


def word_count(text: str = "text") -> Column:
    """Words of a text: runs of characters other than space and 0x09 to 0x0D; none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def first_words(text: str, count: Column) -> Column:
    """The text up to the end of its word number ``count``, with the spaces before and between the words."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), count.cast("int")), "")


def share_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``alloc`` to ``children`` (parent columns, key, weight, cap, budget): each parent's budget by weight,
    at most ``cap`` each, shortages going to the siblings. Weights above 0 only."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("weight"), key)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rate = children.withColumn("r", F.row_number().over(order)).withColumn(
        "rate", (F.col("budget") - F.coalesce(F.sum("cap").over(past), F.lit(0)))
        / (F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(past), F.lit(0))))
    open_ = F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("r", "rate"))
    return (rate.withColumn("first", F.min(open_).over(group))
            .withColumn("alloc", F.coalesce(F.least(F.col("cap").cast("double"), F.col("first.rate") * F.col("weight")), F.col("cap").cast("double")))
            .drop("r", "rate", "first"))


def leaf_budgets(leaves: DataFrame, weights: dict[str, Column], share: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of ``leaves`` (domain, lang, source, tokens): whole tokens for each leaf.

    ``weights`` gives each level's weight from the leaf columns (the same for all leaves of a node); nodes of
    weight 0 or null take nothing. ``share`` of all tokens is the budget of the root.
    """
    weighted = leaves.select("*", *[F.coalesce(weights[c], F.lit(0)).cast("double").alias(f"w_{c}") for c in LEVELS],
                             (F.col("tokens") * epochs).alias("cap"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    live = weighted.withColumn("root", F.floor(total * F.lit(share)).cast("double")).filter(" and ".join(f"w_{c} > 0" for c in LEVELS))
    budget, parent = "root", []
    for level in LEVELS:
        nodes = live.groupBy(*parent, level).agg(F.max(f"w_{level}").alias("weight"), F.sum("cap").alias("cap"),
                                                 F.max(budget).alias("budget"))
        shared = share_out(nodes, parent, level).select(*parent, level, F.col("alloc").alias(f"a_{level}"))
        parent = [*parent, level]
        live, budget = live.join(shared, parent), f"a_{level}"
    return live.select(*LEVELS, "tokens", F.floor(budget).cast("long").alias("budget"))


def select_mix(docs: DataFrame, domain: Column, weights: dict[str, Column], share: float = 0.6, epochs: int = 2,
               seed: int = 1, tokens: Column | None = None, row: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens) of the selected documents, and ``row`` if given.

    ``domain`` is an expression over ``docs`` (doc_id, text, lang, source); nulls in it, lang and source are
    'unknown'. A row is selected where its place in the order of its leaf and epoch starts before the budget
    ends; ``take_tokens`` is the part of it inside the budget, so the takes of a leaf add up to its budget.
    Documents without tokens take 0. Order: md5 of seed, epoch and id, then id; repeated rows are rows of their
    own; a null id is ordered as an empty one. Other columns are ignored; an empty table gives an empty result. ``row`` tells rows apart and orders them where ids repeat.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    own = [] if row is None else ["row"]
    rows = docs.select(F.col("doc_id").cast("long"), *([] if row is None else [row.alias("row")]), named(domain).alias("domain"), named(F.col("lang")).alias("lang"),
                       named(F.col("source")).alias("source"), (word_count() if tokens is None else tokens).alias("n_tokens"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, share, epochs)
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("mark", mark).withColumn(
        "slot", F.substring("mark", 1, 3))
    place = [*LEVELS, "epoch"]
    slots = drawn.groupBy(*place, "slot").agg(F.sum("n_tokens").alias("sum"))
    past = Window.partitionBy(*place).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bounds = slots.withColumn("low", F.coalesce(F.sum("sum").over(past), F.lit(0))).join(budgets, LEVELS).select(
        *place, "slot", "low", (F.col("budget") - F.col("epoch") * F.col("tokens")).alias("left"))
    bounds = bounds.filter("low < left")
    inner = Window.partitionBy(*place, "slot").orderBy("mark", "doc_id", *own).rowsBetween(Window.unboundedPreceding, -1)
    cut = drawn.join(bounds, [*place, "slot"]).withColumn("begin", F.col("low") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return cut.filter("begin < left").select(
        "doc_id", *LEVELS, "epoch", "n_tokens", F.least(F.col("n_tokens"), F.col("left") - F.col("begin")).alias("take_tokens"), *own)


def mixed_documents(docs: DataFrame, domain: Column, weights: dict[str, Column], share: float, epochs: int, seed: int = 1) -> DataFrame:
    """The selected documents with all columns of ``docs``, once per epoch that selects them, each cut to the words it may give.

    Rows are numbered in a written table, so null and repeated ids and equal rows are rows of their own. A row that
    starts inside the budget stays, without words too; the one in which the budget ends is cut behind its last
    word inside it. A null text stays null.
    """
    at = "row"
    while at in docs.columns:
        at += "_"
    rows = reliable(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    chosen = select_mix(rows, domain, weights, share, epochs, seed, row=F.col(at)).select(
        F.col("row").alias(at), (F.col("take_tokens") < F.col("n_tokens")).alias("__cut"), F.col("take_tokens").alias("__take"))
    text = F.when(F.col("__cut"), first_words("text", F.col("__take"))).otherwise(F.col("text"))
    return rows.join(chosen, at).withColumn("text", text).select(*docs.columns)
