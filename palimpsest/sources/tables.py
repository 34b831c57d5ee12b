"""The driver tables as the engine's models: events, hits, documents, vectors, links and stamped facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All ages are taken from this moment.
NOW = "2024-02-01 00:00:00"
#: The moment against which orders are classified.
AS_OF = "1998-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ms, ts, session_id, kind, value, k, outcome): the append-only log."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        millis("ts").alias("ms"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"),
    )


def write_events(df: DataFrame, path: str) -> None:
    """Append events to the archive, by day."""
    df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def scan_events(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """The archive, with the predicate pushed to partitions and files."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.filter(predicate)


TRANSCRIPT = "type string, session_id string, timestamp string, message string, _corrupt string"


def transcript_lines(spark: SparkSession, path: str, include: str = "*") -> DataFrame:
    """(type, .., file, state) of the JSON lines of all files below a folder whose names match ``include``.

    state: ``corrupt`` for lines that do not parse, ``unknown`` for those without a type, else ``read``; none is lost.
    """
    reader = spark.read.option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", include)
    df = reader.schema(TRANSCRIPT).json(path).withColumn("file", F.col("_metadata.file_path"))
    return df.withColumn("state", F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.col("type").isNull(), "unknown").otherwise("read"))


def read_transcripts(spark: SparkSession, path: str, include: str = "*") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the lines that can be read, and how many of each state there are."""
    marked = transcript_lines(spark, path, include)
    return marked.filter("state = 'read'").drop("_corrupt", "state", "file"), marked.groupBy("state").count()


def import_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append: the first of each key that is not there yet."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
