"""Personal data: regular expressions propose spans, checksums confirm them, context moves the score.

Each kind has a pattern, a validator and a base score. Words near a span (up to CONTEXT_CHARS
code points before and after it, no further than the next match of its kind) that speak for
the kind add CONTEXT_BONUS; the sum is held against THRESHOLD. The four base kinds stand without context once their validator
holds. Added kinds: iban (mod-97), imei (Luhn over 15 digits next to a context word; not
where a card was found), ssn and local_phone (only with context), mac addresses, keys of known forms, private-key headers, and secrets:
long runs of letters and digits beside a word such as token or password. An added span
that overlaps a base span is dropped.

Spans are half-open ranges of code points. Everything is native: a pattern splits the
text, the lengths of the parts and of the matches give the positions. Patterns use
possessive repeats, so long runs neither backtrack nor recurse, and positions are summed in
blocks, so the time is nearly linear in the number of matches.

Null and empty texts have no spans. Repeated rows are read one by one. Other columns than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, let, running

CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.4, 0.6


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a match pass the Luhn check."""
    d = F.reverse(digits_of(m))

    def value(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x == 9, F.lit(9)).otherwise(2 * x % 9)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an international account number has the remainder 1 (ISO 7064)."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def count_between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits_of(m)).between(low, high)


def octets(m: Column) -> Column:
    # leading zeros go first, so that a part of any length can be compared
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.substring(q, 1, 3).cast("int"), F.lit(999)) <= 255)))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test of whether a text can hold a match at all.
    hint: str
    valid: Callable[[Column], Column]
    score: float
    context: str = ""


#: In the order in which equal starts are listed. The values are those of the contract,
#: written without backtracking.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", octets, 0.7),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", lambda m: count_between(12, 19)(m) & luhn(m), 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", count_between(9, 15), 0.7),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", mod97, 0.7, "iban|account|konto|compte|cuenta|bank"),
    Kind("imei", r"(?<![0-9-])[0-9]{2}-?[0-9]{6}-?[0-9]{6}-?[0-9](?![0-9-])", "", luhn, 0.3, "imei|device|handset"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), 0.3, "ssn|social security|tax id"),
    Kind("local_phone", r"(?<![0-9+(-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9]{3}[0-9 -]{1,7}[0-9](?![0-9])", "", count_between(7, 13), 0.3, "phone|tel|call|mobile|fax|telefon|anruf|appelez|llame"),
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}+|gh[pousr]_[A-Za-z0-9]{30,}+|sk[-_][A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9_-])", "", lambda m: F.lit(True), 0.9),
    Kind("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", "-----", lambda m: F.lit(True), 0.9),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+", "", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, "token|secret|password|passwd|pwd|api[_ -]?key|credential"),
    Kind("mac", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", ":", lambda m: F.lit(True), 0.6, "mac|hardware|ethernet"),
)
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """The valid spans of one kind, leftmost and not overlapping, with start, order, end, kind, score."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        def between(gaps: Column) -> Column:
            own = F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.struct(m.alias("m"), g.alias("before")))
            return F.zip_with(own, F.slice(gaps, F.lit(2), F.size(ms)), lambda x, g: F.struct(x["m"].alias("m"), x["before"].alias("before"), g.alias("after")))

        def with_starts(xs: Column) -> Column:
            ends = running(xs, F.lit(0), lambda at, x: at + F.length(x["before"]) + F.length(x["m"]))
            return F.zip_with(xs, ends, lambda x, at: F.struct((at + F.length(x["before"])).alias("s"), x.alias("x")))

        return F.filter(let(let(F.split(text, kind.pattern, -1), between), with_starts), lambda y: kind.valid(y["x"]["m"]))

    def scored(y: Column) -> Column:
        x, score = y["x"], F.lit(kind.score)
        if kind.context:
            lo = F.greatest(F.lit(0), F.length(x["before"]) - CONTEXT_CHARS)
            near = ascii_lower(F.concat_ws(" ", F.substring(x["before"], lo + 1, F.lit(CONTEXT_CHARS)), F.substring(x["after"], 1, CONTEXT_CHARS)))
            score = score + F.when(near.rlike(rf"(?<![a-z])(?:{kind.context})"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(y["s"].alias("start"), F.lit(order).alias("ord"), (y["s"] + F.length(x["m"])).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    made = F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.transform(let(found, placed), scored).cast(SPAN))
    return F.when(F.contains(text, F.lit(kind.hint)), made).otherwise(F.array().cast(SPAN)) if kind.hint else made


def without_overlaps(spans: Column) -> Column:
    """spans, in order, without the added ones that overlap a base one."""
    is_base = lambda x: x["ord"] < len(BASE)
    # the furthest end of a base span before, and the next start of one after
    before = running(spans, F.lit(-1), lambda m, x: F.when(is_base(x), F.greatest(m, x["end"])).otherwise(m))
    after = F.reverse(running(F.reverse(spans), F.lit((1 << 31) - 1), lambda m, x: F.when(is_base(x), x["start"]).otherwise(m)))
    sides = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    held = F.zip_with(spans, sides, lambda x, s: F.struct(x.alias("x"), s.alias("s")))
    free = lambda y: is_base(y["x"]) | (y["s"]["b"] <= y["x"]["start"]) & (y["s"]["a"] >= y["x"]["end"])
    return F.transform(F.filter(held, free), lambda y: y["x"])


def with_spans(docs: DataFrame, added: Sequence[Kind] = ADDED, threshold: float = THRESHOLD) -> DataFrame:
    """docs with __base and __all: arrays of spans in order of start, then of kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__base", F.sort_array(F.concat(*(spans_of(text, k, i) for i, k in enumerate(BASE)))))
    more = F.concat(*(spans_of(text, k, len(BASE) + i) for i, k in enumerate(added))) if added else F.array().cast(SPAN)
    d = d.withColumn("__more", F.filter(more, lambda x: x["score"] >= threshold))
    every = let(F.sort_array(F.concat("__base", "__more")), without_overlaps)
    return d.withColumn("__all", F.when(F.size("__more") == 0, F.col("__base")).otherwise(every)).drop("__more")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, **how) -> DataFrame:
    """doc_id and its spans: array<struct<start, end, kind, score>>."""
    d = with_spans(docs.select("doc_id", "text"), **how)
    return d.select("doc_id", F.transform("__all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score"))).alias("spans"))


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans, and n_spans, the number of all of them."""
    d = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *(count(k.name) for k in BASE), F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"), F.size("__all").cast("long").alias("n_spans"))
