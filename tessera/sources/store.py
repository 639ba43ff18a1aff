"""The index as a folder of Parquet tables: chunks, files, vectors, postings and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.operators.incremental import corpus_stats, delete, upsert

TABLES = ("chunks", "files", "vectors", "manifest")


class Store:
    """Reads and writes the tables below one path, on any file system that Spark reads.

    A table is written beside the old one and takes its place by a pointer in the
    manifest of versions, so a lost job leaves the old table whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def is_indexed(self) -> bool:
        return all(map(self.has, ("chunks", "files", "manifest")))

    def read(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            raise LookupError(f"{self.path} has no table {name}; index first")
        return self.spark.read.parquet(f"{self.path}/{name}/v{found[-1]}")

    def write(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        found = self._versions(name)
        at = f"{self.path}/{name}/v{found[-1] + 1 if found else 0}"
        (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.mode("overwrite").parquet(at)
        jvm, fs = self._fs()
        for v in found[:-1]:  # the last one may still be read
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/v{v}"), True)
        return self.read(name)

    def save_chunks(self, chunks: DataFrame) -> DataFrame:
        d = upsert(self.read("chunks"), chunks, ["chunk_id"]) if self.has("chunks") else chunks.dropDuplicates(["chunk_id"])
        return self.write("chunks", d, by="file_path")

    def record_files(self, files: DataFrame) -> DataFrame:
        d = upsert(self.read("files"), files, ["file_path"]) if self.has("files") else files.dropDuplicates(["file_path"])
        return self.write("files", d)

    def delete_files(self, paths: DataFrame) -> None:
        for name in ("chunks", "files"):
            self.write(name, delete(self.read(name), paths, ["file_path"]))

    def clear(self) -> None:
        jvm, fs = self._fs()
        for name in (*TABLES, "bm25"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def chunks_by_ids(self, ids: list[str]) -> DataFrame:
        """The chunks of a short list of ids, in its order; unknown ids are left out."""
        wanted = self.spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "position int, chunk_id string")
        return self.read("chunks").join(F.broadcast(wanted), "chunk_id").orderBy("position")

    def all_chunks(self) -> DataFrame:
        return self.read("chunks").orderBy("file_path", "start_line")

    def file_hashes(self) -> DataFrame:
        return self.read("files").select("file_path", "file_hash")

    def stats(self) -> DataFrame:
        return corpus_stats(self.read("files"))

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.read("manifest").where(F.col("key") == key).select("value").first() if self.has("manifest") else None
        return row.value if row else default

    def put(self, entries: DataFrame) -> None:
        self.write("manifest", upsert(self.read("manifest"), entries, ["key"]) if self.has("manifest") else entries)

    def save_lexical(self, index: bm25.Index) -> None:
        index.save(f"{self.path}/bm25")

    def lexical(self) -> bm25.Index:
        return bm25.Index.load(self.spark, f"{self.path}/bm25")

    def catalogue(self, name: str) -> DataFrame:
        """The tables as temporary views, for SQL."""
        for t in TABLES:
            if self.has(t):
                self.read(t).createOrReplaceTempView(f"{name}_{t}")
        return self.spark.createDataFrame([(t, self.has(t)) for t in TABLES], "name string, ready boolean")
