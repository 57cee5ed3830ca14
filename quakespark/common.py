"""Session, shared scratch tables and small helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g", name: str = "quakespark") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, use the one that is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quakespark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _OWNED.append((spark, folder))
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended; a local folder is then removed directly
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _OWNED:
        _remove(spark, path)


class Scratch:
    """Tables written to the shared folder to cut lineage. They outlive a lost executor, unlike a local checkpoint.

    `keep` writes a DataFrame and reads it back; `drop` removes one that no later step reads. What is left is removed when
    the driver's process ends, as results are read lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _OWNED.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if path := getattr(df, "_scratch_path", None):
            _remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys of a following grouped Python function, into the session's number of partitions: few bytes may mean
    much work there, which adaptive execution, that goes by bytes, would put into one task."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (the session zone must be UTC for the latter)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def first_delivery(df: DataFrame, key: str, loaded_at: str, columns: list[str]) -> DataFrame:
    """One row a key, that of the smallest `loaded_at`: a record counts once, by its first delivery.

    One shuffle by key after map-side combining; with primitive `columns` it stays a hash aggregate (no sort). Rows with a null
    key are dropped. A null loaded_at counts as the latest. Of equal deliveries any may be taken: they are copies of each other.
    """
    at = F.coalesce(F.col(loaded_at).cast("timestamp"), F.lit("9999-01-01 00:00:00").cast("timestamp"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(F.col(c), at).alias(c) for c in columns])
