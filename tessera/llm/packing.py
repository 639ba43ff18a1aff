"""Packing documents into sequences by cutting-stock column generation.

A document longer than a sequence gives full pieces and a rest. A rest over half a
sequence is cut at the half, since long rests leave gaps that nothing fits. The lengths form a histogram over classes that are exact up to EXACT tokens and at
most 1/EXACT of the length wide above. The linear program picks how often to use each
pattern (a multiset of classes that fits a sequence); a knapsack dynamic program over
the dual values finds the pattern worth adding, until none is worth more than 1 + GAP or
the sequences are full but for a share of GAP. Counts are rounded down; what is left, a few pieces for each pattern, is
packed first-fit decreasing. The histogram has some 220 rows whatever the corpus, so
this runs on the driver in bounded time and memory. Pieces are ranked within their
class and patterns take ranges of ranks.

Ids come from a byte-level BPE vocabulary; strings of its special token are that token.
Then id END closes each document. Null texts are empty: the end only. Rows with equal
ids are packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.session import materialize

CAPACITY, END, EXACT, GAP = 2048, 1, 64, 0.004
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@functools.lru_cache(2)
def complete_encoder(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@functools.lru_cache(2)
def fast_encoder(path: str):
    """The same vocabulary in tiktoken, several times as fast, where its ranks lie beside the file; else None."""
    import public_tokenizers
    import tiktoken

    path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text. What the fast encoder refuses (a million white-space characters on end exhaust its
    patterns) goes through the complete one; a lone surrogate counts as a question mark."""
    fast = fast_encoder(path)
    try:
        if fast:
            return fast.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        pass
    return np.array(complete_encoder(path).encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of each document: full ones, then the rest."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(token_ids(text or "", path), END).astype("<u4")
                n = len(ids)
                cuts = [*range(0, n, capacity)]
                if n - cuts[-1] > capacity // 2:
                    cuts.append(cuts[-1] + capacity // 2)
                for s, e in zip(cuts, [*cuts[1:], n]):
                    out.append((i, s, e - s, zlib.crc32(ids[s:e].tobytes()), n))
            if out:
                yield dict(zip(["doc_id", "start", "length", "ids_crc32", "doc_tokens"], zip(*out)))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PIECES, run)


def class_sizes(capacity: int = CAPACITY) -> np.ndarray:
    """The upper ends of the classes of lengths."""
    out, width, top = [*range(1, min(EXACT, capacity) + 1)], 2, 2 * EXACT
    while out[-1] < capacity:
        out += range(out[-1] + width, min(top, capacity) + 1, width) or [capacity]
        if out[-1] < min(top, capacity):
            out.append(min(top, capacity))
        width, top = 2 * width, 2 * top
    return np.array(out)


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern of most value that fits."""
    best = np.zeros(capacity + 1)
    for s, v in zip(sizes, values):
        if v > 0:
            k = 1
            while s * k <= capacity:  # one, two, four ... more of this class
                np.maximum(best[s * k :], best[: capacity + 1 - s * k] + v * k, out=best[s * k :])
                k *= 2
    count, c = np.zeros(len(sizes)), capacity
    while c > 0 and best[c] > 1e-12:
        ok = sizes <= c
        gain = np.where(ok, best[c - np.minimum(sizes, c)] + values - best[c], -1.0)
        gain[values <= 0] = -1.0
        i = int(np.argmax(gain))
        if gain[i] < -1e-9:
            c -= 1
            continue
        count[i] += 1
        c -= int(sizes[i])
    return float(best[capacity]), count


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, most_steps: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that cover the demand exactly. sizes and demand are positive.

    Column generation deals with pieces over EXACT tokens; smaller ones fill the gaps.
    """
    left = demand.astype(np.int64).copy()
    large = np.flatnonzero(sizes > EXACT)
    out = []
    for a, n in column_generation(sizes[large], demand[large], capacity, gap, most_steps):
        full = np.zeros(len(sizes), np.int64)
        full[large] = a
        # patterns may hold more of a class than is left: then fewer of them
        n = min([n, *(left[full > 0] // full[full > 0])])
        if n > 0:
            room = capacity - int(full @ sizes)
            for i in np.flatnonzero(sizes <= min(EXACT, room))[::-1]:
                k = min(left[i] // n, room // sizes[i])
                full[i] += k
                room -= int(k * sizes[i])
            out.append((full, int(n)))
            left -= full * n
    return out + first_fit(sizes, left, capacity)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float, most_steps: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use them: the linear program's solution, rounded down."""
    if not len(sizes):
        return []
    patterns = np.diag(capacity // sizes).astype(float)  # columns
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    least = sizes @ demand / capacity  # no packing needs fewer sequences
    for _ in range(most_steps):
        if x.sum() <= (1 + gap) * least:
            break
        worth, new = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + gap:
            break
        u = inverse @ new
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(np.argmin(ratio))
        patterns[:, r] = new
        inverse[r] /= u[r]
        u[r] = 0
        inverse -= np.outer(u, inverse[r])
        x = np.maximum(inverse @ demand, 0)
    whole = np.floor(x + 1e-7).astype(np.int64)
    return [(patterns[:, j].astype(np.int64), int(whole[j])) for j in np.argsort(-x) if whole[j]]


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs the pieces left, largest first, each sequence filled by the largest pieces that still fit."""
    left, out = left.copy(), []
    by_size = np.argsort(-sizes)
    while left.any():
        a, room = np.zeros(len(sizes), np.int64), capacity
        for i in by_size:
            k = min(left[i], room // sizes[i])
            a[i], room = k, room - k * sizes[i]
            if not room:
                break
        n = int(min(left[a > 0] // a[a > 0]))
        out.append((a, n))
        left -= a * n
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, path), "pieces")
    sizes = class_sizes(capacity)
    ends = F.array(*(F.lit(int(s)) for s in sizes))
    # the number of classes below a length is the place of its own
    pieces = pieces.withColumn("class", F.when(F.col("length") <= min(EXACT, capacity), F.col("length") - 1).otherwise(F.size(F.filter(ends, lambda e: e < F.col("length")))).cast("int"))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # a row a class
    used = np.array(sorted(histogram), np.int64)
    plan, base, taken = [], 0, dict.fromkeys(used.tolist(), 0)
    for a, n in solve(sizes[used] if len(used) else used, np.array([histogram[k] for k in used.tolist()], float), capacity):
        for k, each in zip(used.tolist(), a.tolist()):
            if each:
                plan.append((k, taken[k], taken[k] + each * n, each, base))
                taken[k] += each * n
        base += n
    # for each class a row for each pattern that has it: bounded by the squared number of classes
    table = F.broadcast(spark.createDataFrame(plan, "of int, lo long, hi long, each long, base long"))
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")))
    p = pieces.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    counts = p.groupBy(F.col("class").alias("c"), F.col("bucket").alias("b")).count()
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    p = p.join(offsets, (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("b")))
    order = W.partitionBy("class", "bucket").orderBy("key", "doc_id", "start", "ids_crc32")
    p = p.withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    p = p.join(table, (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    p = p.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("each"))).withColumn("slot", at % F.col("each"))
    fill = W.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(fill), F.lit(0).cast("long"))
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
