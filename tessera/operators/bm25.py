"""BM25 over an inverted index kept as DataFrames.

The index is three tables: postings (chunk_id, term, tf), docs (chunk_id, dl) and terms
(term, df, idf). Search joins the query terms, with their multiplicity, to the postings,
so only chunks that share a term are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.session import materialize

# Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame

    def save(self, path: str) -> None:
        """Postings are laid out by term, so that a search reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "docs", "terms")))


def term_table(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """df and idf by term. Terms with a negative idf get EPSILON times the mean idf over all terms."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    raw = df.join(n, F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg((F.sum(F.col("raw").cast("decimal(28,12)")).cast("double") / F.count("*")).alias("mean")))  # one row
    return raw.join(mean, F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> Index:
    """An index of chunks, which have distinct keys; the tokens are made once, lengths are summed from the postings."""
    tokens = chunks.select(F.col(key).alias("chunk_id"), tokenize(F.col(text)).alias("tokens"))
    tf = tokens.select("chunk_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    postings = materialize(tf, "postings")
    lengths = postings.groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("dl"))
    docs = chunks.select(F.col(key).alias("chunk_id")).join(lengths, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    docs = materialize(docs, "lengths")
    return Index(postings, docs, materialize(term_table(postings, docs), "terms"))


def update(index: Index, gone: DataFrame, fresh: DataFrame, text: str = "text", key: str = "chunk_id") -> Index:
    """The index without the chunks in gone (chunk_id) and with those in fresh; only these are tokenized."""
    new = build(fresh, text, key)
    postings = materialize(index.postings.join(gone, "chunk_id", "left_anti").unionByName(new.postings), "postings")
    docs = materialize(index.docs.join(gone, "chunk_id", "left_anti").unionByName(new.docs), "lengths")
    return Index(postings, docs, materialize(term_table(postings, docs), "terms"))


def search(index: Index, queries: DataFrame, k: int = 50, places: int = 6) -> DataFrame:
    """query_id, rank, chunk_id, score (over 0) for queries (query_id, query).

    Parts are summed as decimals, in any order alike, and scores rounded before ranking;
    ties go by chunk_id, so reruns agree.
    """
    wanted = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # written, so that its size is known: a small one is broadcast and the postings do not move
    wanted = materialize(wanted.join(index.terms.select("term", "idf"), "term"), "wanted")
    mean = F.broadcast(index.docs.agg(F.avg("dl").alias("avgdl")))
    hits = index.postings.join(wanted, "term").join(index.docs, "chunk_id").join(mean, F.lit(True))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part.cast("decimal(28,12)")).cast("double"), places).alias("score")).where("score > 0")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
