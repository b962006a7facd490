"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every plan here counts on. Skewed join keys are split by AQE, also where that costs a shuffle.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The text jobs bind what they use twice; looking for common parts in their nested lambdas takes longer than running them.
    "spark.sql.subexpressionElimination.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, name: str = "offerlake") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")      # a checkpoint goes with the last table read from it
             .config("spark.sql.shuffle.partitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def stated_parts(spark: SparkSession) -> int:
    """In how many parts rows are dealt out whose work does not show in their bytes, by which AQE would bring them together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`. A temporary one is made only for a single-machine session, as in
    tests; on a cluster the setting is required, since executors do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="offerlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that is written and read back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df, name: str):
    """`df` written to the shared folder and read back: for wide rows that are read several times, which take far less room in columns than in a
    checkpoint's rows. It stays as long as the folder does."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df):
    """Materialise `df` in the shared folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
