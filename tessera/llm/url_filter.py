"""URL filter: rules for hosts and path prefixes, else a logistic regression on hashed n-grams.

The model is trained from a small labelled table of URLs by full-batch gradient descent
on the L2-penalised log loss. Weights are combinations of the training rows, so descent
runs on one coefficient a row against the rows' inner products (the dual form), in one
native expression; the weights of the BUCKETS hashed n-grams follow from the
coefficients. Their number bounds what reaches the plan. The penalty is chosen on labelled
names held out. Scoring sums the weights of a URL's n-grams.

The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
the path goes on to "?", "#" or the end. A URL that is null or has no "://" has an empty
host and path. A rule fits its host and all its subdomains if the path starts with the
rule's; the longest that fits wins. Repeated rows are judged one by one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, let
from tessera.session import materialize

#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BUCKETS, LENGTHS = 8192, (3, 4, 5)
#: At most so many labelled rows are used, the first by hash: their inner products are a square table.
MOST_LABELLED = 600
#: URLs as likely as this to be bad are blocked; unknown names lie near one half.
THRESHOLD = 0.7
#: Penalties tried, and the share of names (one in so many) held out to choose among them.
STEPS, MOMENTUM, PENALTIES, HELD = 150, 0.9, (0.001, 0.003, 0.01, 0.03), 4

#: A small labelled table (url, block) of invented addresses, made from two lists of host names.
#: Both get the same endings, sub-hosts and paths in turn, so that only the names tell them apart.
BAD = (
    "ads-banner", "adserve", "ad-click", "popup-ads", "track-pixel", "web-tracker", "stats-track", "ads-network", "casino-royal", "casino-slots",
    "lucky-casino", "poker-bet", "sports-bets", "bet-win", "win-prize", "free-spins", "xxx-videos", "adult-cams", "adult-dating", "porn-tube",
    "sex-chat", "hot-sex", "warez-crack", "keygen-free", "malware-drop", "phish-login", "spam-mails", "spam-offers", "cheap-pills", "click-farm",
    "link-farm", "fast-cash-loans", "replica-watches", "free-bonus", "x-rated", "win-jackpot", "jackpot-city", "spamhaven", "my-porn", "pornhouse",
    "adclicks", "adserver-one", "casinoplanet", "pokerroom", "betmaster", "cash-bonus", "payday-cash", "viagra-shop", "pills-online", "trackers-hub",
)
GOOD = (
    "daily-news", "gardenwriter", "softlib", "university", "citymuseum", "homecook", "cyclists", "booksmith", "weather", "townlibrary",
    "openmaps", "traveller", "newsdesk", "science-letters", "readers", "printerco", "theatre", "schule", "harbour", "hikers",
    "chessclub", "localpaper", "archive", "mathworld", "bakery", "orchestra", "railways", "birdwatch", "language", "thornton",
    "northern", "thatcher", "heather", "otherland", "ration", "station", "edition", "thesis", "sherrington", "anthem",
    "blender", "stable", "ensemble", "listing", "reading", "wharf", "ouse", "nation", "museum-guide", "evening-news",
    "book-club", "trainstation", "roadmap", "headland", "broadway", "breadmaker", "windmill", "winter-walks", "better-garden", "alphabet",
)
ENDINGS, SUBHOSTS, PATHS = ("com", "example.com", "example.org", "info"), ("", "www.", "m.", "blog."), ("/en/13278", "/fr/77.html", "/de/914/", "/es/51097", "/", "/index.html")
LABELLED = tuple(
    (f"https://{SUBHOSTS[(i + k) % 4]}{name}.{ENDINGS[(i + 3 * k) % 4]}{PATHS[(i + k) % 6]}", block)
    for names, block in ((BAD, 1), (GOOD, 0)) for i, name in enumerate(names) for k in range(4)
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*+", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """The buckets of the n-grams of host and path, repeats kept. Each has its own marks, so a gram
    of a host and one of a path differ; the numbers in paths count as one digit."""
    def of(s: Column) -> Column:
        every = [F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i, n=n: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in LENGTHS]
        return F.transform(F.concat(*every), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))

    h = F.concat(F.lit("^"), host, F.lit("$"))
    p = F.concat(F.lit("<"), F.regexp_replace(path, "[0-9]+", "0"), F.lit(">"))
    return F.concat(let(h, of), let(p, of))


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = F.from_json(F.lit(json.dumps([{"url": u, "block": b} for u, b in LABELLED])), "array<struct<url:string,block:int>>")
    return spark.range(1).select(F.inline(rows))


def _descend(rows: Column, fitted: Callable[[Column], Column], penalty: Column) -> Column:
    """One coefficient a row after STEPS steps of descent on the log loss of the rows that are fitted.

    A step is half of what the largest eigenvalue of the inner products allows, bounded by their largest row sum.
    """
    top = F.array_max(F.transform(rows, lambda e: F.aggregate(e["k"], F.lit(0.0), lambda a, x: a + x)))
    z = lambda e, a: F.aggregate(F.zip_with(e["k"], a, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    pull = lambda a, e, i: e["y"] - 1 / (1 + F.exp(-z(e, a))) - penalty * F.get(a, i)

    def whole(rate: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            # s: coefficient and momentum of each row
            moved = lambda a: F.transform(rows, lambda e, i: F.when(fitted(e), MOMENTUM * F.get(s, i)["v"] + rate * pull(a, e, i)).otherwise(F.lit(0.0)))
            after = let(F.transform(s, lambda x: x["a"]), moved)
            return F.zip_with(s, after, lambda x, v: F.struct((x["a"] + v).alias("a"), v.alias("v")))

        start = F.transform(rows, lambda e: F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("v")))
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step), lambda x: x["a"])

    return let(4 / top, whole)


def _held_loss(rows: Column, a: Column) -> Column:
    """The log loss of the rows held out."""
    held = F.filter(rows, lambda e: e["held"])
    z = lambda e: F.aggregate(F.zip_with(e["k"], a, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(held, lambda e: F.log1p(F.exp(F.when(e["y"] > 0, -z(e)).otherwise(z(e))))), F.lit(0.0), lambda s, v: s + v)


def train(labelled: DataFrame) -> list[float]:
    """The weights, one a bucket and last the bias. labelled: url, block (0 or 1); nulls are skipped.

    The penalty is the one with the least log loss on names held out; then all rows are fitted."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and block is not null").dropDuplicates(["url"])
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED).select("url", F.col("block").cast("double").alias("y"), host.alias("host"), grams(host, path).alias("g"))
    # the longest part of a host is its name; URLs of one name are held out together
    name = F.aggregate(F.split("host", r"\."), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    rows = rows.withColumn("held", F.pmod(F.xxhash64(name), F.lit(HELD)) == 0)
    # features: counts over the root of the number of n-grams, so that long URLs weigh as short ones
    x = rows.select("url", "y", "held", F.explode("g").alias("bucket"), (1 / F.sqrt(F.size("g"))).alias("unit")).groupBy("url", "y", "held", "bucket").agg(F.sum("unit").alias("v"))
    x = x.unionByName(rows.select("url", "y", "held", F.lit(BUCKETS).alias("bucket"), F.lit(1.0).alias("v")))
    other = x.select(F.col("url").alias("url2"), "bucket", F.col("v").alias("v2"))
    inner = x.join(other, "bucket").groupBy("url", "y", "held", "url2").agg(F.sum(F.col("v") * F.col("v2")).alias("k"))
    # the table is square: urls that share nothing but the bias are there too
    line = inner.groupBy("url", "y", "held").agg(F.sort_array(F.collect_list(F.struct("url2", "k"))).alias("ks"))
    one = materialize(line.agg(F.sort_array(F.collect_list(F.struct("url", "y", "held", F.transform("ks", lambda e: e["k"]).alias("k")))).alias("r")), "labelled")
    tried = one.select("r", F.explode(F.array(*map(F.lit, PENALTIES))).alias("penalty")).repartition(len(PENALTIES), "penalty")
    fits = tried.select("penalty", let(_descend(F.col("r"), lambda e: ~e["held"], F.col("penalty")), lambda a: _held_loss(F.col("r"), a)).alias("loss"))
    best = min(fits.collect(), key=lambda r: (r.loss is None, r.loss, r.penalty)).penalty  # a row a penalty
    coefficients = _descend(F.col("r"), lambda e: F.lit(True), F.lit(best))
    alpha = one.select(F.explode(F.arrays_zip(F.transform("r", lambda e: e["url"]).alias("url"), coefficients.alias("a"))).alias("z")).select("z.url", "z.a")
    w = x.join(alpha, "url").groupBy("bucket").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    found = {r.bucket: r.w for r in w.collect()}  # BUCKETS + 1 rows at most
    return [found.get(b, 0.0) for b in range(BUCKETS + 1)]


def block_probability(host: Column, path: Column, weights: Sequence[float]) -> Column:
    w = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")

    def score(gs: Column) -> Column:
        z = F.aggregate(gs, F.lit(0.0), lambda a, b: a + F.get(w, b)) / F.sqrt(F.greatest(F.size(gs), F.lit(1)))
        return 1 / (1 + F.exp(-(z + F.lit(float(weights[-1])))))

    return let(grams(host, path), score)


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages (with a column url) with __host, __path, __rule, __p (the model's, where no rule fits) and __verdict."""
    weights = train(labelled if labelled is not None else labelled_table(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    d = pages.withColumns({"__host": host, "__path": path})
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    d = d.withColumns({"__rule": rule, "__by_rule": verdict})
    p = F.when(F.col("__rule").isNull(), block_probability(F.col("__host"), F.col("__path"), weights))
    d = d.withColumn("__p", p)
    return d.withColumn("__verdict", F.coalesce("__by_rule", F.when(F.col("__p") >= threshold, F.lit("block")).otherwise(F.lit("allow")))).drop("__by_rule")


def verdicts(pages: DataFrame) -> DataFrame:
    d = judge_urls(pages.select("page_id", "url"))
    return d.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
