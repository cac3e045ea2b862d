"""Session helpers: reading tables, cutting lineage and shipping bounded tables to workers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest byte size of a Python object that may be broadcast.
BROADCAST_LIMIT = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder the session names.

    ``spark.checkpoint.dir`` is read from the session. Only where neither it nor the context has a folder
    (local tests), a temporary one is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waybill-checkpoint-"))
    return df.checkpoint(eager=True)


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key and content: rows delivered again differ in ``received_at`` only."""
    return df.drop("received_at").dropDuplicates(list(key))


def python_trim(column):
    """Strip all Unicode white space, as people mean it; ``trim`` removes blanks only."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def spread(df: DataFrame, cores_per_partition: int = 1) -> DataFrame:
    """At least one partition per core for a map-only Python stage over a small scan.

    A scan of a few large row groups would otherwise leave most cores idle. It is a round-robin exchange of the
    (already pruned) columns, made only if the scan has fewer partitions than the cluster has cores.
    """
    wanted = max(1, df.sparkSession.sparkContext.defaultParallelism // cores_per_partition)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
