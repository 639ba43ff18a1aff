"""Line deduplication by a tree of log templates.

A line's path through the tree is its number of tokens and its first DEPTH tokens, with
tokens that hold a digit made a wildcard (unless more than MASKED of them do); the
path leads to a leaf. A leaf holds groups, each with a seed. Its line forms come in order
of their documents, most first: a form joins the group whose seed agrees with it in most
tokens, SIMILAR of them at least (the places where they differ are variable fields), or
else opens a group as its seed. A group is a template. One in at least DOCUMENTS documents
that are no copies of each other is recurring, and its lines are dropped from every
document; so leaves with fewer forms of documents are not searched.

Copies do not make their lines recurring. A template in DOCUMENTS texts is frequent. A text
that holds at least half of its words in lines that are not frequent stands for itself. Of
other texts, near copies among them, those that hold a template count once for each of its
neighbours: the least other frequent template (by hash) that the text holds, or none. Near
copies share nearly all of their templates, as small edits leave a line in its group, so a
cluster of any size counts as very few.

Lines end at line feeds. Lines without a token are kept. Null and empty texts stay as they
are. Rows with equal ids and equal texts count as one document. Forms are told apart by
64-bit hashes; within a leaf their tokens are compared, whatever their length. Other
columns, whatever their names and types, pass through.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches
from tessera.session import materialize, scratch

DEPTH, SIMILAR, MASKED, DOCUMENTS = 3, 0.7, 0.5, 10
#: Forms that a task holds before it hands them on.
ROWS = 2000
_DIGIT = re.compile(r"[0-9]")
KEY = ["id", "t"]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def form_of(line: str) -> list[str]:
    """The tokens of a line, variable ones as wildcards."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    masked = ["<*>" if _DIGIT.search(t) else t for t in tokens]
    return masked if masked.count("<*>") <= MASKED * len(masked) else tokens


def leaf_of(form: list[str]) -> int:
    return _hash(f"{len(form)} {' '.join(form[:DEPTH])}")


def _key() -> tuple[Column, Column]:
    """Names a document by its id and text; the rows without an id share one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def line_forms(docs: DataFrame) -> DataFrame:
    """A row for each form in a document: id, t, leaf, form, masked, lines, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ["id", "t", "leaf", "form", "masked", "lines", "words"]
        for b in batches:
            rows = []
            for i, t, text in zip(*(b.column(c) for c in ("id", "t", "text"))):
                i, t, own = i.as_py(), t.as_py(), {}
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    form = form_of(line)
                    if form:
                        masked = " ".join(form)
                        at = own.setdefault(_hash(masked), [leaf_of(form), masked, [], 0])
                        at[2].append(k)
                        at[3] += len(form)
                rows += [(i, t, leaf, h, masked, lines, words) for h, (leaf, masked, lines, words) in own.items()]
                if len(rows) > ROWS:
                    yield dict(zip(names, zip(*rows)))
                    rows = []
            if rows:
                yield dict(zip(names, zip(*rows)))

    d = docs.select(*_key(), "text")
    return map_batches(d, "id long, t long, leaf long, form long, masked string, lines array<int>, words long", run)


@functools.cache
def _blocks(n: int, similar: float) -> tuple[int, list[tuple[int, int]]]:
    """How many of n tokens must agree, and the parts of which one agrees as a whole if they do.

    The first DEPTH agree in a leaf; one part more than places that may differ is a part without any.
    """
    need = next(s for s in range(n + 1) if s / n >= similar)
    free, parts = max(0, n - DEPTH), n - need + 1
    cuts = [n - free + free * k // parts for k in range(parts + 1)]
    return need, list(zip(cuts, cuts[1:]))


class Leaf:
    """The groups of a leaf. Seeds are found by their parts, so a form meets no others."""

    def __init__(self, similar: float):
        self.similar, self.seeds, self.parts = similar, [], {}

    def template(self, form: int, tokens: list[str]) -> int:
        """The seed of the group that a form joins or opens."""
        need, blocks = _blocks(len(tokens), self.similar)
        keys = [(len(tokens), k, *tokens[lo:hi]) for k, (lo, hi) in enumerate(blocks)]
        best = need - 1, 0
        for g in sorted({g for key in keys for g in self.parts.get(key, ())}):
            best = max(best, (sum(map(operator.eq, self.seeds[g][1], tokens)), -g))
        if best[0] >= need:
            return self.seeds[-best[1]][0]
        for key in keys:
            self.parts.setdefault(key, []).append(len(self.seeds))
        self.seeds.append((form, tokens))
        return form


def templates(forms: DataFrame, similar: float = SIMILAR, documents: int = DOCUMENTS) -> DataFrame:
    """form, template: what each form of a leaf belongs to that can hold a recurring template."""
    busy = materialize(forms.groupBy("leaf").count().where(F.col("count") >= documents).select("leaf"), "leaves")
    count = forms.join(busy, "leaf", "left_semi").groupBy("leaf", "form", "masked").agg(F.count("*").alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, leaf = None, None
        for b in batches:
            found = []
            for name, form, masked in zip(*(b.column(c).to_pylist() for c in ("leaf", "form", "masked"))):
                if name != at:
                    at, leaf = name, Leaf(similar)
                found.append(leaf.template(form, masked.split(" ")))
            yield {"form": b.column("form"), "template": found}

    order = count.repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "form")
    return map_batches(order.select("leaf", "form", "masked"), "form long, template long", run)


def recurring_templates(own: DataFrame, totals: DataFrame, documents: int) -> DataFrame:
    """template: those in enough documents apart. own: t, template, words; totals: t, words of a text."""
    texts = materialize(own.groupBy("t", "template").agg(F.max("words").alias("words")), "texts")
    often = texts.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("template")
    held = materialize(texts.join(materialize(often, "often"), "template"), "held")
    # of each text the two least frequent templates by hash; as many as the text has lines at most
    least = held.groupBy("t").agg(F.sum("words").alias("frequent"), F.slice(F.sort_array(F.collect_set("template")), 1, 2).alias("least"))
    least = materialize(least.join(totals, "t").select("t", "least", (2 * (F.col("words") - F.col("frequent")) >= F.col("words")).alias("apart")), "least")
    beside = F.when(F.col("least")[0] == F.col("template"), F.get("least", F.lit(1))).otherwise(F.col("least")[0])
    counted = F.when(F.col("apart"), F.col("t")).otherwise(F.coalesce(beside, F.lit(0)))
    apart = materialize(held.select("t", "template").join(least, "t").select("template", "apart", counted.alias("counted")).distinct(), "apart")
    return apart.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("template")


def recurring(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """id, t, gone: the numbers of the lines to drop from a document."""
    forms = materialize(line_forms(docs), "lines")
    of = materialize(templates(forms, documents=documents), "templates")
    own = materialize(forms.select(*KEY, "form", "lines", "words").join(of, "form").drop("form"), "own")
    totals = forms.groupBy("id", "t").agg(F.sum("words").alias("words")).groupBy("t").agg(F.max("words").alias("words"))
    often = materialize(recurring_templates(own, totals, documents), "recurring")
    return own.join(often, "template").groupBy(*KEY).agg(F.flatten(F.collect_set("lines")).alias("gone"))


def _dropped(docs: DataFrame, documents: int) -> DataFrame:
    """rest (the columns but text), text, n_lines, n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            kept, every, dropped = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                lines = text.split("\n") if text else []
                away = set(gone or ())
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in away) if away else text)
                every.append(len(lines))
                dropped.append(len(away))
            yield {"rest": b.column("rest"), "text": kept, "n_lines": every, "n_dropped": dropped}

    with scratch(docs.sparkSession) as keep:
        gone = keep(materialize(recurring(docs, documents), "gone"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    # gone grows with the corpus, so it is never broadcast: the join is the same at every size
    joined = docs.select(rest, "text", *_key()).join(gone.hint("merge"), KEY, "left").select("rest", "text", "gone")
    kind = joined.schema["rest"].dataType
    out = T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return map_batches(joined, out, run)


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """docs with recurring lines dropped from text, and __lines and __dropped: the numbers of lines
    (not where docs has a column of that name)."""
    own = ["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    counts = {"__lines": "n_lines", "__dropped": "n_dropped"}
    return _dropped(docs, documents).select(*own, *(F.col(c).alias(k) for k, c in counts.items() if k not in docs.columns))


def line_digest(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left."""
    d = _dropped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), documents)
    return d.select("rest.doc_id", "n_lines", "n_dropped", "text")
