"""The symbol graph: nodes and edges as DataFrames, with focus and global views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import citation, sanitize_label
from tessera.session import materialize

# Extensions that count as code, chunks that are read, characters searched for names, steps and nodes of a view.
CODE = (".py", ".go", ".rs", ".ts", ".tsx", ".js", ".jsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala", ".rb", ".php")
MOST_CHUNKS, NAME_CHARS, DEPTH, NODES = 1500, 4096, 2, 40


def graph_chunks(chunks: DataFrame, limit: int | None = MOST_CHUNKS) -> DataFrame:
    """Chunks that name a symbol, of code files, in order of path and line; anonymous blocks are left out."""
    gap = (F.col("symbol_type") == "block") & F.coalesce(F.endswith("symbol_name", F.concat(F.lit("_L"), F.col("start_line").cast("string"))), F.lit(False))
    code = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*CODE)
    d = chunks.where(F.coalesce(F.col("symbol_name"), F.lit("")) != "").where(~F.ilike("symbol_name", F.lit("block_L%"))).where(code & ~gap)
    return d.orderBy("file_path", "start_line", "chunk_id").limit(limit) if limit else d


def nodes(chunks: DataFrame) -> DataFrame:
    """A node for each file (group 1) and each symbol of a file (group 2; the last definition counts)."""
    name = sanitize_label(F.col("symbol_name"))
    c = chunks.withColumn("name", name).where("name <> ''").withColumn("file", F.regexp_extract("file_path", r"([^/]+)$", 1))
    last = F.struct("start_line", "chunk_id")
    pick = lambda col: F.max_by(col, last).alias(col)
    s = c.groupBy("file_path", "name").agg(*(pick(x) for x in ("symbol_type", "file", "end_line", "language", "content")), F.max("start_line").alias("start_line"))
    label = F.when(F.col("symbol_type").isin("function", "method"), F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    sym = s.select(F.concat(F.lit("sym:"), "file_path", F.lit(":"), "name").alias("id"), label.alias("label"), "name", F.col("symbol_type").alias("type"), "file", F.col("file_path").alias("full_path"), "start_line", "end_line", "language", citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"), F.col("content").alias("code"), F.lit(2).alias("group"))
    first = F.struct("start_line", "chunk_id")
    f = c.groupBy("file_path").agg(F.first("file").alias("file"), F.min_by("end_line", first).alias("end_line"), F.min_by("language", first).alias("language"))
    files = f.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.col("file").alias("label"), F.col("file").alias("name"), F.lit("file").alias("type"), "file", F.col("file_path").alias("full_path"), F.lit(1).alias("start_line"), "end_line", "language", F.col("file_path").alias("citation"), F.lit("").alias("code"), F.lit(1).alias("group"))
    return files.unionByName(sym)


def definitions(chunks: DataFrame) -> DataFrame:
    """name, target: the node that a name stands for; the last definition in order of path and line wins."""
    c = chunks.withColumn("name", sanitize_label(F.col("symbol_name"))).where("name <> ''")
    return c.groupBy("name").agg(F.max_by(F.concat(F.lit("sym:"), "file_path", F.lit(":"), "name"), F.struct("file_path", "start_line", "chunk_id")).alias("target"))


def edges(chunks: DataFrame, last_segment: bool = False) -> DataFrame:
    """source, target, relation: which file defines a symbol, and which symbol calls another."""
    c = chunks.withColumn("name", sanitize_label(F.col("symbol_name"))).where("name <> ''").withColumn("id", F.concat(F.lit("sym:"), "file_path", F.lit(":"), "name"))
    defines = c.select(F.concat(F.lit("file:"), "file_path").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("relation")).distinct()
    said = F.regexp_extract_all(F.substring("content", 1, NAME_CHARS), F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0))
    used = F.when(F.size("dependencies") > 0, F.col("dependencies")).otherwise(said)
    d = c.select("id", F.col("name").alias("caller"), F.explode(F.array_distinct(used)).alias("called")).where("called <> caller")
    if last_segment:
        d = d.withColumn("called", F.regexp_extract("called", r"([^.]+)$", 1))
    d = d.withColumn("called", sanitize_label(F.col("called"))).join(definitions(chunks).withColumnRenamed("name", "called"), "called")
    return defines.unionByName(d.select(F.col("id").alias("source"), "target", F.lit("calls").alias("relation")).distinct())


def focus_ids(node_table: DataFrame, edge_table: DataFrame, symbol: str, depth: int = DEPTH) -> DataFrame:
    """id, step: nodes whose label or name holds symbol, and what is up to depth edges away, either way."""
    wanted = symbol.strip().lower()
    reached = node_table.where(F.contains(F.lower("label"), F.lit(wanted)) | F.contains(F.lower("name"), F.lit(wanted))).select("id", F.lit(0).alias("step"))
    both = edge_table.select("source", "target").union(edge_table.select("target", "source")).distinct().toDF("id", "next")
    for k in range(depth):
        more = both.join(reached.where(F.col("step") == k).select("id"), "id", "left_semi").select(F.col("next").alias("id")).distinct().join(reached, "id", "left_anti")
        reached = materialize(reached.unionByName(more.withColumn("step", F.lit(k + 1))), "reached")
    return reached


def view(node_table: DataFrame, edge_table: DataFrame, symbol: str | None = None, depth: int = DEPTH, limit: int = NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges around a symbol, or of all files and the first symbols if there is none."""
    order = ("full_path", "group", "start_line", "id")
    if symbol:
        ids = focus_ids(node_table, edge_table, symbol, depth).select("id")
        if ids.limit(1).count():
            ns = node_table.join(ids, "id", "left_semi").orderBy(*order).limit(limit)
            inside = edge_table.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
            return ns, inside.orderBy("source", "target", "relation").limit(2 * limit)
    ns = node_table.where("group = 1").unionByName(node_table.where("group = 2").orderBy(*order).limit(limit))
    ids = ns.select("id")
    return ns, edge_table.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def metrics(ns: DataFrame, es: DataFrame) -> DataFrame:
    n = ns.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("group") == 1).alias("total_files"), F.count_if(F.col("group") == 2).alias("total_symbols"))
    return n.join(F.broadcast(es.agg(F.count("*").alias("total_edges"))), F.lit(True))
