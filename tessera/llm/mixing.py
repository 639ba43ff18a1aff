"""Mixing sources to target weights along a curriculum.

A source's weight may change over training time: its schedule is a piecewise linear
curve of (time, weight) knots. The integral of the curve, scaled to the source's
target, is the demand for its words up to a time. The documents of a source stand in
a fixed random order (by MD5 of the id); the words before a document, put into the
inverse of the demand, give its training position. Documents are range-sorted by
position. A source whose target is above its size is passed through twice; the
document at which the target is reached is cut there.

Targets: sources in code-point order, null last, get the weights in turn and share
epochs times all words; none gets more than cap times its own words, and what is
above is shared again by weight (water-filling, in closed form over the sources
sorted by the level at which they fill up).

Sums over a source never meet in one task: documents are dealt to buckets by the
leading digits of the MD5, buckets of a source are summed first, and running sums
within a bucket start from the bucket's offset.

Null texts have size 0 and are taken 0 times. Null sources are one source. Rows with
equal ids and sizes are interchangeable. An empty table gives an empty result. Other
columns, whatever their names, pass through mix_documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import let, word_count

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS, CAP = 1.5, 2.0
#: Knots (time, relative weight), in turn like the weights: early, even, late.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Leading hexadecimal digits of the MD5 that make a bucket: 4096 buckets a source.
DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, cap: float = CAP) -> DataFrame:
    """One row a source: __source, source_size, rank, target. sizes: __source, __size (may be partial sums)."""
    src = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    ranked = src.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("__source"))) - 1)
    weight = F.array(*map(F.lit, map(float, weights)))[F.col("rank") % len(weights)]
    s = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("k", F.row_number().over(order))
    s = s.withColumn("demand", F.sum("source_size").over(W.partitionBy()) * float(epochs))
    level = (F.col("demand") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))).over(W.partitionBy())
    s = s.withColumn("level", first["level"])
    return s.select("__source", "source_size", "rank", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def inverse_demand(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time in 0..1 at which the integral of a schedule has reached share (0..1) of its whole."""
    rows = []
    for knots in schedules:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        done, whole = 0.0, sum(areas)
        segs = []
        for ((t0, w0), (t1, w1)), a in zip(zip(knots, knots[1:]), areas):
            segs.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("done", done / whole), ("t0", t0), ("w0", w0), ("slope", (w1 - w0) / (t1 - t0)), ("whole", whole)))))
            done += a
        rows.append(F.array(*segs))
    own = F.array(*rows)[kind]
    seg = F.aggregate(own, own[0], lambda a, x: F.when(x["done"] <= share, x).otherwise(a))

    def solve(s: Column) -> Column:
        y = (share - s["done"]) * s["whole"]
        # w0 u + slope u^2 / 2 = y, in the form without cancellation
        return s["t0"] + F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * s["slope"] * y))))

    return F.least(F.lit(1.0), let(seg, solve))


def plan(docs: DataFrame, carry: Sequence[str] = (), weights=WEIGHTS, epochs: float = EPOCHS, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """carry columns, __id, __size, source_size, target, __bucket, __number (a key of the row), __t1, __t2 (words taken
    in the first and the second pass), __p1, __p2 (their positions). docs is read twice: for the sums and for the rows."""
    key = F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")))
    size = word_count(F.col("text"))
    d = docs.select(*(F.col(f"`{c}`") for c in carry), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), size.alias("__size"))
    # one key that is never null serves the join and the windows, so rows move once
    d = d.withColumn("__key", key).withColumn("__bucket", F.concat(F.substring("__key", 1, DIGITS), F.coalesce(F.concat(F.lit("="), "__source"), F.lit(""))))
    sums = d.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__size"))
    by_bucket = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(sums, weights, epochs, cap).withColumnRenamed("__source", "__s")
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__size").over(by_bucket), F.lit(0))).drop("__size")
    offsets = offsets.join(targets, F.col("__source").eqNullSafe(F.col("__s"))).select("__bucket", "__before", "source_size", "rank", "target")
    both = d.join(offsets, "__bucket")
    within = W.partitionBy("__bucket").orderBy("__key", F.asc_nulls_first("__id"), "__size")
    earlier = F.coalesce(F.sum("__size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("__before", F.col("__before") + earlier).withColumn("__number", F.row_number().over(within))
    budget = F.floor("target")
    take = lambda left: F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), left)).cast("long")
    share = lambda c: F.coalesce(F.least(F.lit(1.0), c / F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0))
    kind = F.col("rank") % len(schedules)
    return both.select(
        *(F.col(f"`{c}`") for c in carry), "__id", "__size", "source_size", "target", "__bucket", "__number",
        take(budget - F.col("__before")).alias("__t1"), take(budget - F.col("source_size") - F.col("__before")).alias("__t2"),
        inverse_demand(share(F.col("__before")), kind, schedules).alias("__p1"), inverse_demand(share(F.col("__before") + F.col("source_size")), kind, schedules).alias("__p2"),
    )


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first pass, to nine places; null if not taken)."""
    p = plan(docs.select("doc_id", "source", "text"), **how)
    taken = F.col("__t1") + F.col("__t2")
    return p.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"), F.when(taken > 0, F.round("__p1", 9)).alias("position"))


def mixture(docs: DataFrame, others: bool = False, **how) -> DataFrame:
    """The columns of plan, row (a struct of the columns of docs) and text, range-sorted by __p, the training position.

    A row for each time that a document is taken, with the text as taken: a document that the
    target cuts keeps its leading words. With others, documents that are never taken follow,
    once each, with null for __p, row and text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    p = plan(docs.select(row, "doc_id", "source", "text"), ["row"], **how)
    passes = F.filter(F.array(*(F.struct(F.col(f"__t{k}").alias("t"), F.col(f"__p{k}").alias("p")) for k in (1, 2))), lambda x: x["t"] > 0)
    p = p.withColumn("__pass", (F.explode_outer if others else F.explode)(passes))
    if others:  # their texts do not move again
        p = p.withColumn("row", F.when(F.col("__pass").isNotNull(), F.col("row")))
    pieces = F.split("row.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    # white space before the first word is a piece of its own
    lead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    head = F.array_join(F.slice(pieces, F.lit(1), (F.col("__pass.t") + lead).cast("int")), "")
    text = F.when(F.col("__pass.t") < F.col("__size"), head).otherwise(F.col("row.text"))
    return p.sort(F.asc_nulls_last("__pass.p"), "__id").withColumn("__p", F.col("__pass.p")).withColumn("text", text)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture: a row for each time that a document is taken, range-sorted by training position.

    The columns are those of docs. A document that the target cuts keeps its leading words.
    """
    return mixture(docs, **how).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    """The columns of mix_plan, derived from the mixture itself: the words of the texts in it, and the
    position where a document first comes in the sorted order."""
    m = mixture(docs.select("doc_id", "source", "text"), others=True, **how)
    m = m.withColumn("__words", word_count(F.col("text"))).withColumn("__place", F.monotonically_increasing_id())
    own = m.groupBy("__bucket", "__number", F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target")
    digest = own.agg(F.sum("__words").alias("taken"), F.round(F.min_by("__p", "__place"), 9).alias("position"))
    return digest.drop("__bucket", "__number")
