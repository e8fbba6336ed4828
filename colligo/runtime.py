"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``. Where that is unset, a fresh folder in local mode;
    on a cluster executors do not share a disk with the driver, so there the setting is demanded."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="colligo-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the checkpoint folder, so that a later use neither recomputes them nor
    depends on one executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions to aim at: the session's shuffle setting, at least the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows``, columns of the scan ``source``, in enough partitions for work that costs far more than reading.

    A scan splits by bytes: a table of few megabytes, or of one large row group, gives fewer tasks than there are cores.
    Then, and only then, the rows are dealt out; a table with a partition for every core stays where it is read."""
    spark = source.sparkSession
    wanted = parallelism(spark)
    try:
        size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a client without a plan at hand: the scan's own partitions
        return rows
    return rows.repartition(2 * wanted) if size < wanted * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else rows


def _bytes(setting: str) -> int:
    """A size setting in bytes: a number, with or without a unit of powers of 1024."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", setting.lower())
    if m is None:
        raise ValueError(f"no size: {setting!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")
