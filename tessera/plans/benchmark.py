"""A synthetic source tree, and a run that indexes it, searches it and reports speed and quality."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import language_of
from tessera.operators import evaluation
from tessera.plans.search import Engine, Settings

#: Subjects and actions of the invented modules; a module has one of each.
SUBJECTS = (
    "account", "audit", "basket", "booking", "cache", "calendar", "catalog", "checkout", "coupon", "currency",
    "delivery", "discount", "export", "gateway", "inventory", "invoice", "ledger", "mailbox", "notice", "payment",
    "permit", "profile", "quota", "refund", "report", "session", "stock", "tariff", "token", "voucher",
)
ACTIONS = ("approve", "archive", "cancel", "convert", "estimate", "import", "merge", "price", "validate")
#: The shares of the languages, in hundredths.
SHARES = (("python", "py", 60), ("typescript", "ts", 25), ("go", "go", 15))
METHODS = 12


def _body(language: str, subject: Column, action: Column, number: Column) -> Column:
    """The text of a module: a type and METHODS functions."""
    name, each = F.concat(F.initcap(subject), F.initcap(action), number), F.sequence(F.lit(1), F.lit(METHODS))
    call = lambda k: F.concat(action, F.lit("_"), subject, F.lit("_"), number, F.lit("_"), k.cast("string"))
    if language == "python":
        head = F.concat(F.lit('"""The '), subject, F.lit(" module.\"\"\"\n\nimport math\n\n\nclass "), name, F.lit(':\n    """Can '), action, F.lit(" the "), subject, F.lit('."""\n\n'))
        one = lambda k: F.concat(F.lit("    def "), call(k), F.lit('(self, value, limit):\n        """Step '), k.cast("string"), F.lit(" to "), action, F.lit(" a "), subject, F.lit('."""\n        if value > limit:\n            return limit\n        return math.floor(value)\n\n'))
        return F.concat(head, F.array_join(F.transform(each, one), ""))
    if language == "typescript":
        one = lambda k: F.concat(F.lit("  "), call(k), F.lit("(value: number, limit: number): number {\n    if (value > limit) {\n      return limit;\n    }\n    return value;\n  }\n\n"))
        return F.concat(F.lit("export class "), name, F.lit(" {\n"), F.array_join(F.transform(each, one), ""), F.lit("}\n"))
    one = lambda k: F.concat(F.lit("func (x *"), name, F.lit(") "), call(k), F.lit("(value int, limit int) int {\n\tif value > limit {\n\t\treturn limit\n\t}\n\treturn value\n}\n\n"))
    return F.concat(F.lit("package "), subject, F.lit("\n\ntype "), name, F.lit(" struct {\n\tcount int\n}\n\n"), F.array_join(F.transform(each, one), ""))


def modules(spark: SparkSession, lines: int) -> DataFrame:
    """file_path, text, subject, action, number, language: modules of `lines` lines together at least; the same each time."""
    count = -(-lines // (6 * METHODS))
    d = spark.range(count).withColumn("number", F.col("id").cast("string"))
    d = d.withColumn("subject", F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("id") % len(SUBJECTS) + 1).cast("int")))
    d = d.withColumn("action", F.element_at(F.array(*map(F.lit, ACTIONS)), (F.floor(F.col("id") / len(SUBJECTS)) % len(ACTIONS) + 1).cast("int")))
    place, low, text, path, kind = F.col("id") * 37 % 100, 0, F.lit(None), F.lit(None), F.lit(None)
    for language, ending, share in SHARES:
        here = (place >= low) & (place < low + share)
        text = F.when(here, _body(language, F.col("subject"), F.col("action"), F.col("number"))).otherwise(text)
        path = F.when(here, F.concat(F.lit("src/"), "subject", F.lit("/"), "action", F.lit("_"), "number", F.lit(f".{ending}"))).otherwise(path)
        kind = F.when(here, F.lit(language)).otherwise(kind)
        low += share
    return d.select(path.alias("file_path"), text.alias("text"), "subject", "action", "number", kind.alias("language"))


def source_tree(spark: SparkSession, lines: int) -> DataFrame:
    """The modules and a Markdown file as a table of files, as a folder would be read."""
    notes = spark.range(1).select(F.lit("README.md").alias("file_path"), F.concat(F.lit("# Subjects\n\n"), F.array_join(F.array(*map(F.lit, SUBJECTS)), "\n"), F.lit("\n")).alias("text"))
    d = modules(spark, lines).select("file_path", "text").unionByName(notes)
    count = F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)).cast("int")
    return d.select("file_path", "text", F.sha2("text", 256).alias("file_hash"), language_of(F.col("file_path")).alias("language"), count.alias("total_lines"), F.octet_length("text").cast("long").alias("total_bytes"))


def questions(spark: SparkSession, lines: int, count: int) -> DataFrame:
    """query_id, query, target_symbol, expected_file: the report's `count` questions, one a module, spread by hash."""
    d = modules(spark, lines).orderBy(F.xxhash64("file_path"), "file_path").limit(count)
    query = F.concat(F.lit("where does "), "subject", F.lit(" "), "action", F.lit(" in "), F.initcap("subject"), F.initcap("action"), "number")
    return d.select(F.monotonically_increasing_id().alias("n"), query.alias("query"), F.concat("action", F.lit("_"), "subject", F.lit("_"), "number").alias("target_symbol"), F.col("file_path").alias("expected_file"))


def run(spark: SparkSession, index: str, lines: int = 5000, count: int = 5, settings: Settings = Settings()) -> dict:
    """Indexes a source tree, searches it once to warm up and once for each question, and reports."""
    engine, files = Engine(spark, "", index), source_tree(spark, lines)
    began = time.perf_counter()
    engine.index(force=True, files=files)
    spent = time.perf_counter() - began
    total = engine.store.read("files").agg(F.sum("total_lines").alias("n")).first().n
    asked = [r.asDict() for r in questions(spark, lines, count).collect()]  # `count` rows
    engine.timed_search([asked[0]["query"]], settings)
    times, records = [], []
    for k, a in enumerate(asked):
        hits, ms = engine.timed_search([a["query"]], settings)
        rows = hits.orderBy("final_rank").collect()  # as many as settings.k
        times += [(stage, float(v)) for stage, v in ms.items()]
        records.append((k, a["expected_file"], a["target_symbol"], [r.file_path for r in rows], [r.symbol_name or "" for r in rows]))
    stats = evaluation.latency_stats(spark.createDataFrame(times, "stage string, ms double"), by=("stage",))
    quality = evaluation.retrieval_metrics(spark.createDataFrame(records, "query_id long, expected_file string, target_symbol string, retrieved_files array<string>, retrieved_symbols array<string>"))
    return {
        "schema_version": 1, "lines": int(total), "files": files.count(), "index_seconds": round(spent, 3), "lines_per_second": round(total / max(spent, 0.001), 2),
        "latency": {r.stage: {c: v for c, v in r.asDict().items() if c != "stage"} for r in stats.collect()}, "quality": quality.first().asDict(),
    }


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as one JSON document."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
