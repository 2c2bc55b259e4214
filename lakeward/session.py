"""Session helpers.

Library code never creates a session on its own: it takes the caller's.
``get_session`` is for tests, the bench and local runs only.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on for exact results against the oracle:
# zone-free timestamps and a UTC session zone.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

# Settings for scale: adaptive execution re-plans joins from real shuffle
# sizes (broadcast only when the measured side is small), splits skewed
# partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above on an existing session."""
    for key, value in {**RESULT_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def get_session(cores: int | str = "*", shuffle_partitions: int = 8,
                app_name: str = "lakeward") -> SparkSession:
    """Local session for tests and benchmarks (UI off, no server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LAKEWARD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RESULT_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as the cluster names it;
    only when it is unset on a ``local`` master (tests) a fresh scratch
    folder is taken; on any other master an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lakeward-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


_scopes = threading.local()


def scratch_database(spark: SparkSession) -> str:
    """The database of written intermediates; its tables lie under the shared checkpoint folder."""
    root = checkpoint_dir(spark).rstrip("/")
    name = "lakeward_" + hashlib.md5(root.encode()).hexdigest()[:12]
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{root}/lakeward-tables'")
    return name


def materialize(df, label: str, bucket: str | None = None):
    """Cut ``df``'s lineage by writing it once as a table under the shared checkpoint folder, and read it back.

    The plan runs once (an eager ``checkpoint()`` of an unpersisted frame
    runs it twice); the files live on shared storage, so a lost executor
    does not lose them.  Each call makes a fresh table, in buckets of
    ``bucket`` if named; ``scratch`` drops it when it is no longer needed.
    """
    spark = df.sparkSession
    name = f"{scratch_database(spark)}.{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write
    if bucket is not None:
        writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket)
    writer.saveAsTable(name)
    out = spark.table(name)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append((out, name))
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Own the tables that ``materialize`` writes within: they are dropped at the end, with their files.

    Yields ``keep``: a table given to it (as ``materialize`` returned it)
    passes to the scope around, or stays if there is none.  An error drops
    all of them.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    mine, kept = [], []
    _scopes.open.append(mine)

    def keep(df):
        kept.append(df)
        return df

    done = False
    try:
        yield keep
        done = True
    finally:
        _scopes.open.pop()
        for df, name in mine:
            if done and any(df is k for k in kept):
                if _scopes.open:
                    _scopes.open[-1].append((df, name))
            else:
                spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(df) -> None:
    """Drop a table of an open scope before the scope's end."""
    for scope in reversed(getattr(_scopes, "open", [])):
        for entry in [e for e in scope if e[0] is df]:
            scope.remove(entry)
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {entry[1]}")
            return
