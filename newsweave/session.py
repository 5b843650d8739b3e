"""Session helpers: settings, the shared work folder and the size check used before broadcasting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension-sized inputs (watch-lists, sources, question sets) are broadcast up to this many rows.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("newsweave")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers, once per application, so that functions of its modules can be unpickled there."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="newsweave-")) / "newsweave.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(archive))


def use_utc(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: `spark.checkpoint.dir` of the cluster.  Only a local session without
    that setting gets a temporary folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = sc.getCheckpointDir()
        if current is not None:
            folder = current
        elif sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-newsweave-", dir="/tmp")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/newsweave/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage through a table in the shared folder: computed once, safe when executors are lost."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_in = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Delete tables of `checkpointed` that nothing reads any more.  Only for tables whose readers have all been stored themselves."""
    for table in tables:
        path = getattr(table, "_stored_in", None)
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Does the input have at most `max_rows` rows, and these at most `max_bytes` as text?  Reads no more than that many rows."""
    head = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("n")).limit(max_rows + 1)
    found = head.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the checked rows and bytes are within the bounds; otherwise leave the join to a shuffle
    (adaptive execution then splits skewed keys)."""
    return F.broadcast(df) if is_small(df, max_rows) else df
