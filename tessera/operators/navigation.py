"""Code navigation for batches of requests: at a position, definitions, references, hover, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters of a snippet, names in a completion list, the end character of a range, kinds of names.
SNIPPET, NAMES, END_CHARACTER = 300, 50, 80
KINDS = {"function": 3, "class": 7}
OTHER_KIND = 6


def _range(d: DataFrame) -> tuple[Column, ...]:
    """0-based lines, as editors count them."""
    return (F.col("start_line") - 1).alias("start_0"), (F.col("end_line") - 1).alias("end_0"), F.lit(END_CHARACTER).alias("end_character")


def at_position(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id, chunk_id, symbol_name: the first chunk that holds line (0-based) of file_path.

    The file is the join key and the range a condition on it, so no request meets other files.
    """
    c = chunks.select("file_path", "chunk_id", "symbol_name", "start_line", "end_line")
    d = requests.join(c, "file_path").where((F.col("line") + 1 >= F.col("start_line")) & (F.col("line") + 1 <= F.col("end_line")))
    return d.groupBy("request_id").agg(F.min_by(F.struct("chunk_id", "symbol_name"), F.struct("start_line", "chunk_id")).alias("x")).select("request_id", "x.*")


def definitions(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id and the places that define symbol, whatever its case."""
    c = chunks.where("symbol_name is not null").withColumn("__k", F.lower("symbol_name"))
    d = requests.withColumn("__k", F.lower("symbol")).join(c, "__k")
    return d.select("request_id", "file_path", *_range(d))


def references(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id and the chunks of other names whose content holds symbol.

    Requests are a stated set of symbols: the longest identifier of each is joined to the
    distinct identifiers of each chunk by its trigrams, then the text is searched.
    """
    grams = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))
    long = requests.where(F.length("symbol") >= 3).withColumn("__g", F.element_at(F.array_sort(grams(F.col("symbol"))), 1))
    text = chunks.where(F.length("content") >= 3).withColumn("__g", F.explode(grams(F.col("content"))))
    holds = F.contains("content", F.col("symbol")) & (F.coalesce("symbol_name", F.lit("")) != F.col("symbol"))
    found = long.join(text, "__g").where(holds)
    # names of one or two letters: by the distinct letters and pairs of letters of each chunk
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("content") - (n - 1)), lambda i: F.substring(F.col("content"), i, F.lit(n)))
    pairs = F.when(F.length("content") >= 2, parts(2)).otherwise(F.array().cast("array<string>"))
    short = requests.where(F.length("symbol").between(1, 2)).withColumn("__g", F.col("symbol"))
    every = short.join(chunks.where(F.length("content") >= 1).withColumn("__g", F.explode(F.array_distinct(F.concat(parts(1), pairs)))), "__g").where(holds)
    return found.select("request_id", "file_path", *_range(found)).unionByName(every.select("request_id", "file_path", *_range(every)))


def hover(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id, chunk_id, snippet, documentation of the first chunk at the position or of the name."""
    c = chunks.select("file_path", "chunk_id", "symbol_name", "start_line", "end_line", "content", "docstring")
    place = requests.join(c, "file_path").where((F.col("line") + 1).between(F.col("start_line"), F.col("end_line"))).select("request_id", *(F.col(x) if x != "file_path" else F.col("file_path") for x in c.columns))
    named = requests.select("request_id", F.lower("symbol").alias("__k")).join(c.where("symbol_name is not null").withColumn("__k", F.lower("symbol_name")), "__k").select("request_id", *c.columns)
    first = place.unionByName(named).groupBy("request_id").agg(F.min_by(F.struct("chunk_id", "content", "docstring"), F.struct("file_path", "start_line", "chunk_id")).alias("x"))
    return first.select("request_id", "x.chunk_id", F.trim(F.substring("x.content", 1, SNIPPET)).alias("snippet"), F.coalesce("x.docstring", F.lit("No documentation.")).alias("documentation"))


def completion(chunks: DataFrame, names: int = NAMES) -> DataFrame:
    """label, kind, place: the first distinct names in order of path and line."""
    c = chunks.where(F.coalesce("symbol_name", F.lit("")) != "").where(~F.startswith("symbol_name", F.lit("block_L")))
    d = c.groupBy(F.col("symbol_name").alias("label")).agg(F.min(F.struct("file_path", "start_line", "chunk_id", "symbol_type")).alias("x"))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in KINDS.items() for v in kv)), F.col("x.symbol_type")), F.lit(OTHER_KIND))
    return d.orderBy("x").limit(names).select("label", kind.alias("kind"), F.concat("x.file_path", F.lit(":"), F.col("x.start_line").cast("string")).alias("place"))


def inspect(requests: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Definitions, references and hover of the same requests."""
    return {"definitions": definitions(requests, chunks), "references": references(requests, chunks), "hover": hover(requests, chunks)}
