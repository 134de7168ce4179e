"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Stencil chains do much work on few bytes; the default of 1 MB leaves cores idle.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName("strandline")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandline-")
    return _own[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandline-{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over spark.sql.shuffle.partitions tasks, by keys if there are any.

    For rows that are few but stand for much work each (a station for all its days, a tile for its
    pixels): adaptive execution sizes tasks by bytes and would give them to one task. A repartition by
    number is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once to the shared folder and go on from the written table.

    Two uses: it cuts the lineage of iterative work in a way that outlives a lost
    executor, and it gives a small aggregate an exact size. Catalyst then broadcasts
    it in later joins only while it is under spark.sql.autoBroadcastJoinThreshold and
    falls back to a shuffle join beyond that, so no join here carries a hint.
    Zstandard, as whole texts and columns of row numbers take about half the disk they take by default.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
