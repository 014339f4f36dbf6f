"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of an Arrow batch, unless the session says otherwise: documents are long, and
#: Spark's own 10,000 put tens of MB into every buffer on the way to a Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workers_ready(spark: SparkSession) -> None:
    """The shared folder is known, the Python workers can import this package, and batches are small."""
    checkpoint_dir(spark)
    ship_package(spark)
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    Cuts the lineage: a lost executor costs the tasks that read the table, never
    the work that made it. The folder is the one in ``spark.checkpoint.dir``.
    ``compression``: None for the session's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/docspark-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if a count says that it has at
    most ``rows``; the join then leaves the other side where it lies, else it shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_lookup(rows: DataFrame, facts: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row a ``key``), however many rows share a key.

    ``uses``: a column of ``facts`` that bounds a key's rows, ``total`` their sum. Keys
    with a thousandth of ``total`` or more are at most 1,000: they are broadcast, and
    their rows stay where they lie; the other keys meet by a shuffle. Both frames
    are read twice: store them before."""
    hot = F.col(uses) * F.lit(1000) >= F.lit(total)
    few = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(facts.where(~hot), key))


def crc_mod(column, n: int):
    """CRC-32 of an id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)
