"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine: tests, the benchmark and interactive use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that reaches a Python worker: whole texts are held, so few at a time.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers find the package, and keeps their batches small."""
    # Python workers of a local session start elsewhere; a cluster gets the package by --py-files
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a temporary folder of this machine is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets later plans see real sizes.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    _made.append(path)
    return out


#: Folders that materialize has written and nothing has removed.
_made: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _made:
            _made.remove(path)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that materialize gave, once nothing reads them any more."""
    for df in tables:
        if getattr(df, "tessera_path", None):
            _remove(df.sparkSession, [df.tessera_path])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables made inside, but for those given to the function that it yields."""
    start, kept = len(_made), []
    yield lambda df: (kept.append(df.tessera_path), df)[1]
    _remove(spark, [p for p in _made[start:] if p not in kept])


def drop_all(spark: SparkSession) -> None:
    """Removes all tables that materialize has given, and shuffle files of plans that are gone."""
    _remove(spark, list(_made))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
