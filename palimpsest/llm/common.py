"""Helpers shared by the operators: shared storage, column access and fold assignment."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where a local master has none set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def stored(df: DataFrame, name: str = "step", rows: int | None = None, file_rows: int = 250_000) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; it is removed when the driver ends.

    ``rows``: a bound of its rows where one is known; small tables then make few files, one a core at least.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // file_rows)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove the table behind ``stored()`` as soon as nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(spark, f)


def free_memory() -> None:
    """Hand what a batch no longer needs back to the system: Python workers live on, idle, after their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """``run`` (batches -> batches), memory handed back when a task's batches end."""

    def whole(batches):
        yield from run(batches)
        free_memory()

    return whole


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def with_text_columns(df: DataFrame, text_col: str, added: list[tuple[str, str]], make) -> DataFrame:
    """``df`` with columns computed from whole texts in Arrow batches; its other columns pass untouched.

    ``make()`` is called once a task and returns a function: list of texts (null: empty) -> one list or
    array for each added (name, type). Columns of these names that ``df`` has are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kept = df.drop(*[c for c, _ in added])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), *(f"`{c}` {t}" for c, t in added)])
    kinds = [to_arrow_type(_parse_datatype_string(t)) for _, t in added]

    def run(batches):
        compute = make()
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            made = compute(texts) if texts else [[] for _ in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, type=k) for v, k in zip(made, kinds))], names=[*b.schema.names, *(c for c, _ in added)])

    return kept.mapInArrow(run, schema)
