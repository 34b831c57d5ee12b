"""Tables that cut the lineage of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where a local master has none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="palimpsest-")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


#: Rows of one task where ``spread`` deals them out.
ROWS = 500_000


def parts_of(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as give about ``ROWS`` of ``rows`` to each, at least one a core.

    Adaptive execution keeps a number that is given: what one task holds does not grow with the table.
    """
    return df.repartition(parts_of(df.sparkSession, rows), *keys)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, key: str | None = None, rows: int = 0) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as ``cut`` has it, and what removes it: rounds keep no table that a later one has taken the place of.

    With ``key`` it is written by ``key`` in as many buckets as ``spread`` gives to ``rows``: joins by ``key`` send only
    what they join it with.
    """
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    atexit.register(remove, spark, path)
    if key is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)
    spread(df, rows, key).write.bucketBy(parts_of(spark, rows), key).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)

    return spark.table(name), drop
