"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over WIDTH code points triggers a boundary where its low bits are all
ones. The block size is the
smallest power of two with at most LENGTH chunks, so the whole text is always covered;
boundaries of a larger block size are boundaries of the smaller ones too. A fingerprint is "block:signature:signature at the double block", a
signature one base-64 character a chunk. Fingerprints compare at the block sizes they
share: by 1 - d / (m + n), d the insertions and deletions that turn one signature into
the other, and 0 if they share no run of RUN characters (of half the shorter one, where that is less).

The edited text of a document needs the next document's head, so rows are dealt to
ranges of ids, each with a copy of the row that follows it, and read in order. Texts
move once.

Null texts are empty. Empty texts have the fingerprint "1::" and likeness 1 to each
other, 0 to others. Rows with equal ids follow in the order of their texts. With one
row the next document is itself. Rows without an id come last.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

LENGTH, WIDTH, RUN = 64, 7, 6
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the places of the rolling window and of the chunk hash.
PLACES = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) | 1) for k in range(WIDTH)]
BASE = 0x94D049BB133111EB
#: Code points of the texts that are held at once, and that are hashed together.
BATCH_CHARS = 2_000_000
BLOCK_CHARS = 100_000
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    """BASE ** i (or its inverse) mod 2 ** 64 for i < n."""
    if len(_powers[name]) < n:
        base = np.uint64(BASE if name == "up" else pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
    return _powers[name][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of texts, worked out together in blocks that fit a processor's cache."""
    out: list[str] = []
    lo = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars > BLOCK_CHARS or k == len(texts) - 1:
            out += _fingerprints(texts[lo : k + 1])
            lo, chars = k + 1, 0
    return out


def _fingerprints(texts: list[str]) -> list[str]:
    out = ["1::"] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return out
    gap = WIDTH - 1  # zeros between texts keep the rolling window inside one
    lengths = np.array([len(texts[k]) for k in some])
    starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
    x = code_points(("\0" * gap).join(texts[k] for k in some)).astype(np.uint64) + np.uint64(1)
    for j in range(gap):
        x[starts[1:] - 1 - j] = 0
    n, ends = len(x), starts + lengths - 1
    with np.errstate(over="ignore"):
        rolling = x * PLACES[0]
        for k in range(1, min(WIDTH, n)):
            rolling[k:] += x[: n - k] * PLACES[k]
        bits = _mixed(rolling)
        sums = np.cumsum(x * MIX * _power("up", n), dtype=np.uint64)
    bits[ends] = ~np.uint64(0)  # the end closes the last chunk, at each block size
    at = np.flatnonzero(x)
    doc = np.repeat(np.arange(len(some)), lengths)
    level, done = 0, np.full(len(some), -1)
    signs: list[list[str]] = [[] for _ in some]
    while True:
        count = np.bincount(doc, minlength=len(some))
        fits = (done < 0) & (count <= LENGTH)
        done[fits] = level
        use = np.flatnonzero((done == level) | (done >= 0) & (done == level - 1))
        if len(use):
            wanted = np.zeros(len(some), bool)
            wanted[use] = True
            mine = wanted[doc]
            last, d = at[mine], doc[mine]
            first = np.empty_like(last)
            new = np.concatenate([[True], d[1:] != d[:-1]])
            first[1:] = last[:-1] + 1
            first[new] = starts[d[new]]
            with np.errstate(over="ignore"):
                before = np.where(first > 0, sums[first - 1], np.uint64(0))
                chunk = _mixed((sums[last] - before) * _power("down", n)[first] + (last - first).astype(np.uint64))
            letters = ALPHABET[(chunk & np.uint64(63)).astype(np.int64)].tobytes().decode()
            cuts = np.flatnonzero(new).tolist() + [len(last)]
            for k, lo, hi in zip(d[new].tolist(), cuts, cuts[1:]):
                signs[k].append(letters[lo:hi])
        if (done >= 0).all() and (done < level).all():
            break
        keep = (bits[at] >> np.uint64(level)) & np.uint64(1) == 1
        at, doc, level = at[keep], doc[keep], level + 1
    for k, (i, s) in enumerate(zip(some, signs)):
        out[i] = f"{1 << done[k]}:{s[0]}:{s[1]}"
    return out


def fingerprint(text: str) -> str:
    return fingerprints([text])[0]


def _shares_run(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each row whether two signatures share a run, of half the shorter one at most."""
    short = np.minimum(la, lb)
    need = np.minimum(run, np.where(short > 1, np.maximum(short // 2, 2), short))
    out = np.zeros(len(a), bool)
    for k in np.unique(need):
        if not k:
            continue
        at = np.flatnonzero(need == k)
        codes = []
        for s, n in ((a, la), (b, lb)):
            w = s.shape[1] - k + 1
            g = np.zeros((len(at), w), np.int64)
            for j in range(k):
                g = (g << 7) | s[at, j : j + w]
            codes.append(np.where(np.arange(w)[None, :] + k <= n[at, None], g, -1 - len(codes)))
        x, y = codes
        both = np.sort(np.concatenate([np.sort(x, axis=1) * 2, np.sort(y, axis=1) * 2 + 1], axis=1), axis=1)
        # equal codes of both sides stand next to each other after sorting
        out[at] = ((both[:, 1:] ^ both[:, :-1]) == 1).any(axis=1) if (both >= -4).all() else False
    return out


def _similar(a: list[str], b: list[str]) -> np.ndarray:
    """1 - indel distance / (m + n) of pairs of signatures, by bit-parallel longest common subsequences."""
    la, lb = np.array([*map(len, a)]), np.array([*map(len, b)])
    width = LENGTH
    as_rows = lambda xs: np.frombuffer(b"".join(x.encode().ljust(width, b"\0") for x in xs), np.uint8).reshape(len(xs), width)
    ra, rb = as_rows(a), as_rows(b)
    masks = np.zeros((len(a), 128), np.uint64)
    rows = np.arange(len(a))
    for j in range(width):
        masks[rows, ra[:, j]] |= np.uint64(1 << j)
    masks[:, 0] = 0
    v = np.full(len(a), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for j in range(width):
            u = v & masks[rows, rb[:, j]]
            v = (v + u) | (v - u)
    inside = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & inside).astype(float)
    score = np.where(la + lb > 0, 2 * lcs / np.maximum(la + lb, 1), 1.0)
    return np.where((la + lb == 0) | _shares_run(ra, rb, la, lb), score, 0.0)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of pairs of fingerprints, 0 to 1: the best over the block sizes both have."""
    pa, pb = [x.split(":") for x in a], [x.split(":") for x in b]
    best = np.zeros(len(a))
    for i in (1, 2):
        for j in (1, 2):
            at = [k for k, (x, y) in enumerate(zip(pa, pb)) if int(x[0]) << i == int(y[0]) << j]
            if at:
                best[at] = np.maximum(best[at], _similar([pa[k][i] for k in at], [pb[k][j] for k in at]))
    same = np.array([x == y for x, y in zip(a, b)], bool)
    return np.where(same, 1.0, best)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, without moving texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "fingerprint": fingerprints([t or "" for t in b.column("text").to_pylist()])}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string", run)


def _literal(values: list, kind: str) -> F.Column:
    """An array as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) dealt to ranges of descending ids: __part, __copy, doc_id, text. Each range ends
    with a copy (__copy) of the first row after it; the last range's is the first row of all."""
    quantiles = docs.where("doc_id is not null").select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first().q or []
    bounds = sorted(set(quantiles))  # at most `ranges` numbers
    ids = F.col("doc_id")
    array = _literal(bounds, "array<bigint>")
    part = F.when(ids.isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(array, lambda b: b >= ids)))
    heads = {r.part: r.id for r in docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("id")).collect()}  # a row a range
    order = sorted(heads)
    sent = {p: order[k - 1] for k, p in enumerate(order)}  # the head of a range goes to the range before it, of the first to the last
    of_part = lambda values, kind: F.get(_literal([values.get(p) for p in range(len(bounds) + 2)], kind), F.col("__own"))
    to = of_part(sent, "array<int>")
    d = docs.withColumn("__own", part)
    is_head = of_part(heads, "array<bigint>").eqNullSafe(ids)
    both = F.array(F.struct(F.col("__own").alias("p"), F.lit(False).alias("c")), F.struct(to.alias("p"), F.lit(True).alias("c")))
    d = d.withColumn("__to", F.explode(F.when(is_head, both).otherwise(F.slice(both, 1, 1))))
    return d.select(F.col("__to.p").alias("__part"), F.col("__to.c").alias("__copy"), "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows come by __part, copies last, ids descending, then by text."""
    held: list[tuple] = []
    chars = 0

    def out(rows: list[tuple]) -> dict:
        """Of all rows but the last and the copies, each against the row after it."""
        own, made = [], []
        for (p, c, i, t), (q, d, _, u) in zip(rows, rows[1:]):
            if not c and p == q:
                n = len(t)
                e = t[: n - n // 3] + u[: n // 3]
                own.append((i, n, e, t, u))
        texts = list(dict.fromkeys(s for x in own for s in x[2:]))
        prints = dict(zip(texts, fingerprints(texts)))
        for i, n, e, t, u in own:
            made.append((i, n, hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), prints[t], prints[e], prints[u]))
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next"]
        d = dict(zip(names, map(list, zip(*made)))) if made else {c: [] for c in names}
        return d | {"near_edited": likeness(d["fingerprint"], d["edited_fingerprint"]), "near_next": likeness(d["fingerprint"], d["next"])}

    last_part = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("__part", "__copy", "doc_id")), (t or "" for t in b.column("text").to_pylist())):
            if row[1] and last_part == (row[0], "done"):
                continue  # equal heads: the first copy is the one that follows
            held.append(row)
            chars += len(row[3])
            last_part = (row[0], "done" if row[1] else "open")
            if chars > BATCH_CHARS:
                yield out(held)
                held, chars = held[-1:], 0
    if held:
        yield out(held)


def edit_digest(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = with_next(d, ranges).repartitionByRange(ranges, "__part")
    ordered = dealt.sortWithinPartitions("__part", "__copy", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return map_batches(ordered, OUT, _edited)
