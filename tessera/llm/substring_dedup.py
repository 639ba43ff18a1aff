"""Substring deduplication by sliding sentence spans.

A text is cut after sentence marks and line ends. From every sentence a span starts: the
shortest run of consecutive sentences with at least SENTENCES sentences and WORDS words
(or LONG words, however few the sentences). Spans are hashed (lower case, white space
made even) and joined over all documents; sentences covered by any occurrence of a
repeated span but its first, in the order of doc_id, text and place, are removed.

Hashes have 64 bits. Null and empty texts have no sentences. A text without a repeated
span comes back as it was. Rows with equal ids and equal texts are one document: none
of their spans repeats another's. Rows without an id come last. Other columns, whatever
their names and types, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches
from tessera.session import materialize, scratch

SENTENCES, WORDS, LONG = 2, 15, 30
_MARK = re.compile(r"([.!?]+\s+|\n\s*)")
KEY = ["id", "t"]


def sentences(text: str) -> list[str]:
    """The pieces of a text; joined, they are the text. Pieces without a word go with the one before."""
    parts = _MARK.split(text)
    out: list[str] = []
    for s, mark in zip(parts[::2], [*parts[1::2], ""]):
        piece = s + mark
        if not piece:
            continue
        if out and not s.strip():
            out[-1] += piece
        else:
            out.append(piece)
    return out


def spans(pieces: list[str]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of the span from each sentence that has one."""
    words = [p.lower().split() for p in pieces]
    lines, sizes, out = [" ".join(w) for w in words], [len(w) for w in words], []
    for i in range(len(pieces)):
        j, n = i, 0
        while j < len(pieces) and not (n >= LONG or j - i >= SENTENCES and n >= WORDS):
            n += sizes[j]
            j += 1
        if n >= LONG or j - i >= SENTENCES and n >= WORDS:
            out.append((xxhash.xxh64_intdigest("\n".join(lines[i:j]).encode("utf-8", "surrogatepass")) - (1 << 63), i, j - i))
    return out


def _key() -> tuple[Column, Column]:
    """Names a document by its id and text; the rows without an id share one, the last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def all_spans(docs: DataFrame) -> DataFrame:
    """h, id, t, k (the first sentence), n (how many) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [(h, i, t, k, n) for i, t, text in zip(*(b.column(c).to_pylist() for c in ("id", "t", "text"))) for h, k, n in spans(sentences(text or ""))]
            if rows:
                yield dict(zip(["h", "id", "t", "k", "n"], zip(*rows)))

    return map_batches(docs.select(*_key(), "text"), "h long, id long, t long, k int, n int", run)


def repeated(docs: DataFrame) -> DataFrame:
    """id, t, gone: the numbers of the sentences that repeat an earlier span."""
    every = materialize(all_spans(docs), "spans")
    place = F.struct(*KEY, "k")
    first = every.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    # a table of its own, so that the rows of a span with very many occurrences can be split in the join
    first = materialize(first, "first")
    again = materialize(every.join(first, "h").where(place != F.col("first")).select(*KEY, "k", "n"), "again")
    # of each document its covered sentences: their number is bounded by its own length
    return again.select(*KEY, F.explode(F.sequence("k", F.col("k") + F.col("n") - 1)).alias("s")).groupBy(*KEY).agg(F.collect_set("s").alias("gone"))


def _removed(docs: DataFrame) -> DataFrame:
    """rest (the columns but text), text, n_sentences, n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            kept, every, removed = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                pieces = sentences(text or "")
                away = set(gone or ())
                kept.append("".join(p for k, p in enumerate(pieces) if k not in away) if away else text)
                every.append(len(pieces))
                removed.append(len(away))
            yield {"rest": b.column("rest"), "text": kept, "n_sentences": every, "n_removed": removed}

    with scratch(docs.sparkSession) as keep:
        gone = keep(materialize(repeated(docs), "gone"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    # rows whose text is one sentence or has no repeat go through the join as well: nothing is dropped
    joined = docs.select(rest, "text", *_key()).join(gone, KEY, "left").select("rest", "text", "gone")
    kind = joined.schema["rest"].dataType
    out = T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return map_batches(joined, out, run)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with text stripped of repeated spans, __sentences and __removed: their numbers
    (not where docs has a column of that name)."""
    own = ["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    counts = {"__sentences": "n_sentences", "__removed": "n_removed"}
    return _removed(docs).select(*own, *(F.col(c).alias(k) for k, c in counts.items() if k not in docs.columns))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left."""
    d = _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return d.select("rest.doc_id", "n_sentences", "n_removed", "text")
