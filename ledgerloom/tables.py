"""Access to the Parquet tables of a data directory, and the session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table `name` of `data_dir`; columns are pruned and filters pushed by whoever uses it."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def local_session(cores: int | str = "*", name: str = "ledgerloom") -> SparkSession:
    """A session for tests and benches on one machine; on a cluster, the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
