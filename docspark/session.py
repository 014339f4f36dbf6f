"""Session helpers.

Library code never creates a session on its own; it uses the active one.
``get_session`` exists for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Rows per Arrow batch sent to Python: documents run to 100s of KB, so the
    # default 10,000 rows could put GBs into one worker's batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "docspark") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DOCSPARK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docspark`` importable in the Python workers (``addPyFile``).

    The package is zipped once into the shared checkpoint folder and added to
    the SparkContext, which distributes it to every executor. Clusters that
    install the package on all nodes can skip this (it is idempotent)."""
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    target = f"{checkpoint_dir(spark).rstrip('/')}/docspark-pkg/docspark-{digest}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is read
    as is; where it is unset, that is an error. Only a local master, whose one
    machine shares all folders, gets a private one.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf_dir:
        conf_dir = sc.getCheckpointDir()
        if not conf_dir and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = conf_dir or tempfile.mkdtemp(prefix="docspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The input is persisted for the duration: writing a checkpoint otherwise
    recomputes the whole input a second time."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


#: Inputs under this size a core are spread before a Python stage.
SMALL_BYTES = 16 << 20


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a small scan over all cores; anything else is returned as it is.

    A table of a few small Parquet files is read by as many tasks, which leaves
    a heavy row-by-row stage on a core or two. The decision takes the plan's own
    size estimate and the number of files: no job is run, and no shuffle added
    to an input of any size."""
    plan = df._jdf.queryExecution().optimizedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and size < SMALL_BYTES * cores and 0 < len(df.inputFiles()) < cores:
        return df.repartition(2 * cores)
    return df
