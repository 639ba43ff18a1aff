"""Quality rules with risk-controlled thresholds.

Every document gets a few badness measures. For each measure and stratum a grid of
cutoffs is tried, most lenient first. A cutoff is certified if, by an exact binomial
test on labelled good documents, at most alpha of the good documents would be
rejected: P(Binomial(n, alpha) <= rejected) <= delta. Within a grid the tests run in
a fixed sequence that ends at the first failure, which needs no correction; alpha and
delta are divided among measures, and delta among strata too (Bonferroni). So with
probability 1 - delta no stratum loses more than alpha of its good documents. Of the
certified cutoffs, the one that parts low from good quality best on the other half of
the labels is used; a measure without a useful certified cutoff rejects nothing.

All of it is DataFrame expressions; the table of cutoffs has at most
len(STRATA) + 1 rows and is the only thing that is broadcast.

Null or empty texts have no words, so base_failed holds for them. Null languages and
those not in STRATA form the stratum "other". Null or missing labels are not used.
Repeated rows are judged one by one. Other columns, whatever their names, pass through
filter_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, let, total, words
from tessera.session import materialize

STRATA = ("en", "de", "fr", "es")
WINDOW = 8
#: Measures and their grids of cutoffs, most lenient first; a value above the cutoff is bad.
GRIDS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "mark_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06),
    "repeat_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ALPHA, DELTA = 0.06, 0.1
#: A rejected good document weighs as much as so many rejected bad ones.
GOOD_COST = 3.0


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts with an equal pair are sorted.
    """

    def covered(hs: Column) -> Column:
        def by_position(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(at, lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))).cast("long"))))

        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(pairs, by_position))

    def windows(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hw) - (window - 1)), lambda i: F.xxhash64(F.slice(hw, i, window)))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < window, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), covered))


def with_features(docs: DataFrame, out: str = "__q") -> DataFrame:
    """docs with a struct of the counts and measures of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = docs.withColumn("__w", words(F.col("text")))
    counts = {
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit(r"[!?|{}=\[\]~^@]")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_repeat_words": repeat_words(F.col("__w")),
    }
    d = d.withColumn("__c", F.struct(*(c.alias(k) for k, c in counts.items()))).drop("__w")
    c = {k: F.col(f"__c.{k}") for k in counts}
    share = lambda a, b: F.coalesce(a / F.greatest(b, F.lit(1)), F.lit(0.0)).cast("double")
    n_dup = F.col("__c.lines.dup")
    known = F.col("lang").isin(*STRATA) if "lang" in docs.columns else F.lit(False)
    made = {
        **{k: c[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")},
        "n_dup_lines": n_dup,
        "base_failed": (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"]),
        "stratum": F.when(known, F.col("lang") if "lang" in docs.columns else F.lit(None)).otherwise(F.lit("other")),
        "symbol_share": share(c["n_symbols"], c["word_chars"]),
        "mark_share": share(c["n_marks"], c["word_chars"]),
        "upper_share": share(c["n_upper"], c["word_chars"]),
        "repeat_share": share(c["n_repeat_words"], c["n_words"]),
        "dup_line_share": share(n_dup, F.col("__c.lines.n")),
        "word_length": share(c["word_chars"], c["n_words"]),
    }
    # a generator of one row keeps filters from being pushed below, where they would repeat the work
    return d.withColumn(out, F.explode(F.array(F.struct(*(v.alias(k) for k, v in made.items()))))).drop("__c")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + float(k))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed from the largest term down; 1 where k >= n p."""
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    down = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: let(a["t"] * (kd - j) / (nd - kd + j + 1) * ((1 - p) / p), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))),
        lambda a: a["s"],
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * down))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum: stratum, cutoff map<measure, double>.

    labelled: the feature struct's columns with good boolean and held boolean (test half).
    """
    m = len(GRIDS)
    alpha_m, delta_m = alpha / m, delta / (m * (len(STRATA) + 1))
    above = lambda k: lambda c: F.col(k) > c
    measures = F.array(*(F.struct(F.lit(k).alias("measure"), (F.lit(len(g) + 1) - F.size(F.filter(F.array(*map(F.lit, g)), above(k)))).alias("level")) for k, g in GRIDS.items()))
    counts = (
        labelled.where(~F.col("base_failed"))
        .select("stratum", "good", "held", F.explode(measures).alias("x"))
        .groupBy("stratum", "x.measure", "x.level")
        .agg(*(F.count_if(c).alias(a) for a, c in (("k", F.col("good") & F.col("held")), ("good_design", F.col("good") & ~F.col("held")), ("bad_design", ~F.col("good") & ~F.col("held")))))
    )
    whole = W.partitionBy("stratum", "measure")
    so_far = whole.orderBy("grid_level").rowsBetween(W.unboundedPreceding, 0)
    grid = F.create_map(*(x for k, g in GRIDS.items() for x in (F.lit(k), F.array(*map(F.lit, g)))))
    # level j: cutoff j is the first that the value is above; cutoff j rejects the levels up to j
    full = counts.groupBy("stratum", "measure").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("k", "good_design", "bad_design")))).alias("m"))
    full = full.select("stratum", "measure", "m", F.explode(F.sequence(F.lit(1), F.size(grid[F.col("measure")]) + 1)).alias("grid_level"))
    zero = F.lit(0).cast("long")
    full = full.select("stratum", "measure", "grid_level", *(F.coalesce(F.try_element_at("m", F.col("grid_level"))[c], zero).alias(c) for c in ("k", "good_design", "bad_design")))
    full = full.select("stratum", "measure", "grid_level", F.sum("k").over(whole).alias("n"), *(F.sum(c).over(so_far).alias(c) for c in ("k", "good_design", "bad_design"))).where(F.col("grid_level") <= F.size(grid[F.col("measure")]))
    tested = full.withColumn("passed", F.min((F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), alpha_m) <= delta_m)).over(so_far))
    gain = F.col("bad_design") - GOOD_COST * F.col("good_design")
    best = (
        tested.where(F.col("passed") & (gain > 0))
        .groupBy("stratum", "measure")
        .agg(F.max(F.struct(gain.alias("gain"), (-F.col("grid_level")).alias("l"))).alias("b"))
        .select("stratum", F.struct("measure", F.element_at(grid[F.col("measure")], -F.col("b.l")).alias("cutoff")).alias("e"))
    )
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list("e")).alias("cutoff"))


def calibrate(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs from features (doc_id, __q) and labels (doc_id, quality); all labelled rows count."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    both = features.select("doc_id", "__q").join(good, "doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return cutoffs(both.select("__q.*", "good", held.alias("held")), alpha, delta)


def judge(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """features with __kept. cuts has a row for each stratum at most, so it is broadcast."""
    cuts = cuts.select(F.col("stratum").alias("__s"), F.col("cutoff").alias("__cut"))
    d = features.join(F.broadcast(cuts), F.col("__q.stratum") == F.col("__s"), "left")
    bad = F.lit(False)
    for k in GRIDS:
        bad = bad | F.coalesce(F.col(f"__q.{k}") > F.try_element_at("__cut", F.lit(k)), F.lit(False))
    return d.withColumn("__kept", ~F.col("__q.base_failed") & ~bad).drop("__s", "__cut")


def score_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept. The counts are made once and written; texts are not shuffled."""
    lang = ["lang"] if "lang" in docs.columns else []
    features = materialize(with_features(docs.select("doc_id", "text", *lang)).select("doc_id", "__q"), "quality")
    judged = judge(features, calibrate(features, labels, alpha, delta))
    return judged.select("doc_id", *(F.col(f"__q.{c}") for c in FEATURES), F.col("__q.base_failed"), F.col("__kept").alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    lang = ["lang"] if "lang" in docs.columns else []
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # texts are written once with their counts, which take far longer than that
    features = materialize(with_features(docs.select(row, "doc_id", "text", *lang)).select("row", "doc_id", "__q"), "quality")
    cuts = materialize(calibrate(features, labels, alpha, delta), "cutoffs")
    return judge(features, cuts).where("__kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))
