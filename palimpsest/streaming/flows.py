"""Structured Streaming over the event log: series, session ends, idempotent delivery, budgets, upserts.

The flows read the log as a file stream and run until all that is there is read; the output is a table in the shared
folder. Aggregates run in complete mode, their state being one row a group; delivery once keeps no state but the
delivered rows themselves.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.catalog import Entry
from palimpsest.sources.shared import remove, shared_folder
from palimpsest.sources.tables import events, table


def work_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files; the pattern in the path lets it be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """(event_id, ts, session_id, kind, value): the log as a stream, some files a micro-batch."""
    raw = table_stream(spark, sf_dir, "events", files_per_trigger)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), "value")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All results of a stream over what is there now; rows still within the watermark are not yet out in append mode."""
    spark = stream.sparkSession
    base = work_dir(spark)
    atexit.register(remove, spark, base)
    out = f"{base}/out"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda df, n: df.write.mode("overwrite").parquet(out)  # noqa: E731  each batch holds the whole result
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def series(stream: DataFrame, width: str) -> DataFrame:
    """Events and sums a tumbling window."""
    return stream.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "errors")


def m06(spark, sf_dir):
    return run_to_end(series(event_stream(spark, sf_dir), "1 hour"), "complete")


def session_ends(stream: DataFrame, idle: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions that an idle gap ends; with ``late`` only those that a watermark has passed, for append mode."""
    rows = stream.withWatermark("ts", late) if late else stream
    s = rows.groupBy("session_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"))
    return s.select("session_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def m04(spark, sf_dir):
    return run_to_end(session_ends(event_stream(spark, sf_dir)), "complete")


def delivered_once(stream: DataFrame, keys: list[str], base: str | None = None, buckets: int = 64) -> DataFrame:
    """One row of each key, however late and in whatever micro-batch its repeats come; nulls are equal to each other.

    What was delivered lies in ``buckets`` by a hash of the key, and a batch reads those that its own keys fall into.

    A batch is what it holds of keys that no earlier batch has delivered, written to a folder of its own; a batch that
    is run again after a failure replaces it. With the same ``base`` a later call goes on where the last one ended.
    """
    spark = stream.sparkSession
    if base is None:
        base = work_dir(spark)
        atexit.register(remove, spark, base)
    names = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def deliver(batch: DataFrame, n: int) -> None:
        fresh = batch.dropDuplicates(keys).withColumn("_bucket", bucket)
        if n:
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            earlier = batch.sparkSession.read.schema(f"{names}, batch long, _bucket int").parquet(f"{base}/out")
            earlier = earlier.filter((F.col("batch") < n) & F.col("_bucket").isin(touched)).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]  # nulls are equal, as in dropDuplicates
            fresh = fresh.join(earlier, same, "left_anti")
        fresh.write.partitionBy("_bucket").mode("overwrite").parquet(f"{base}/out/batch={n}")

    spark.createDataFrame([], stream.schema).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").mode("append").parquet(f"{base}/out/batch=-1")  # also if nothing comes
    stream.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{names}, batch long, _bucket int").parquet(f"{base}/out").drop("batch", "_bucket")


def m07(spark, sf_dir):
    twice = event_stream(spark, sf_dir)
    return delivered_once(twice.unionByName(event_stream(spark, sf_dir)), ["event_id"]).select("event_id", "kind")


def split_bad(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with the reasons why a row is refused; an empty list: it is good."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def m03(spark, sf_dir):
    """Dead letters by reason."""
    checked = split_bad(event_stream(spark, sf_dir), {"low_value": F.col("value") >= 1, "kind": F.col("kind") != "signup"})
    bad = checked.filter(F.size("reasons") > 0).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return run_to_end(bad, "complete")


def a38(spark, sf_dir):
    """Spend counters by day and session, as a running upsert."""
    spend = event_stream(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "session_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return run_to_end(spend, "complete")


def budget_states(df: DataFrame, limit: int) -> DataFrame:
    """Normal, Warn, Degrade or Halt by what a session has spent up to each event."""
    w = Window.partitionBy("session_id").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("cents").over(w)
    state = F.when(spent >= limit, "halt").when(spent >= 0.9 * limit, "degrade").when(spent >= 0.7 * limit, "warn").otherwise("normal")
    return df.withColumn("state", state)


def m15(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return budget_states(ev, 100000).groupBy("state").agg(F.count("*").alias("n"))


def token_bucket(rows: DataFrame, key: str, ms: str, burst: float, per_second: float) -> DataFrame:
    """(key, ms, ok): each request in time order against its caller's bucket, which refills while nobody asks.

    A pause in which the bucket fills up makes what follows independent of what was before, so histories are split there
    and their parts spread over the tasks. Within a part the state is what is left and when; a part of any length streams
    through its task in sorted batches.
    """
    full_ms = burst / per_second * 1000
    w = Window.partitionBy(key).orderBy(ms)
    rested = F.coalesce((F.col(ms) - F.lag(ms).over(w) >= full_ms).cast("int"), F.lit(0))
    parts = rows.select(key, ms).withColumn("_rested", rested)
    parts = parts.withColumn("_part", F.sum("_rested").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rested")

    def admit(batches):
        part, left, at = None, burst, 0
        for batch in batches:
            ok = []
            for k, t, p in zip(batch[key], batch[ms], batch["_part"]):
                if (k, p) != part:
                    part, left, at = (k, p), burst, t
                left = min(burst, left + (t - at) / 1000 * per_second)
                at = t
                ok.append(left >= 1)
                left -= ok[-1]
            yield batch[[key, ms]].assign(ok=ok)

    schema = T.StructType([rows.schema[key], rows.schema[ms], T.StructField("ok", T.BooleanType())])
    return parts.repartition(key, "_part").sortWithinPartitions(key, "_part", ms).mapInPandas(admit, schema)


def m14(spark, sf_dir):
    daily = events(spark, sf_dir).select(F.expr("ms div 86400000 * 100 + session_id % 100").alias("caller"), "ms")
    b = token_bucket(daily, "caller", "ms", 2.0, 1 / 14400)
    return b.groupBy("caller").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("refused"))


def m05(spark, sf_dir):
    """Sessions whose count of purchases has reached the threshold."""
    hot = event_stream(spark, sf_dir).filter("kind = 'purchase'").groupBy("session_id").agg(F.count("*").alias("n")).filter("n >= 5")
    return run_to_end(hot, "complete")


def m13(spark, sf_dir):
    """Replay of the archive into an index: documents' terms counted from the beginning."""
    docs = table_stream(spark, sf_dir, "documents")
    return run_to_end(docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), "complete")


def m08(spark, sf_dir):
    """Micro-batches of node properties: the latest of each key counts."""
    stream = event_stream(spark, sf_dir).groupBy("session_id", "kind").agg(F.max_by("value", "event_id").alias("value"))
    return run_to_end(stream, "complete")


def s05(spark, sf_dir):
    """The tail after a checkpoint: rows beyond the last id seen, in batch as in a resumed stream."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    seen = ev.agg(F.floor(F.max("event_id") * 0.9).alias("seen"))
    return ev.join(F.broadcast(seen)).filter("event_id > seen").select("event_id", F.col("event_type").alias("kind"))  # one row


ENTRIES = {
    "M03_dead_letters": Entry(m03, "select 'low_value' reason, count(*) n from events where value<1 group by 1 union all select 'kind', count(*) from events where event_type='signup' group by 1"),
    "M04_session_ends": Entry(m04, "with a as (select user_id, ts, case when ts-lag(ts) over w<=interval 30 minutes then 0 else 1 end nw from events window w as (partition by user_id order by ts)), b as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) v from a) select user_id session_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start, count(*) n from b group by user_id, v"),
    "M05_thresholds": Entry(m05, "select user_id session_id, count(*) n from events where event_type='purchase' group by 1 having count(*)>=5"),
    "M06_series": Entry(m06, "select strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M') as start, count(*) n, count(*) filter (event_type='error') errors from events group by 1"),
    "M07_once": Entry(m07, "select distinct event_id, event_type kind from events"),
    "M08_upserts": Entry(m08, "select user_id session_id, event_type kind, arg_max(value,event_id) as value from events group by 1,2"),
    "M13_replay": Entry(m13, "select source, lang, count(*) n, cast(sum(n_chars) as bigint) chars from documents group by 1,2"),
    "M14_rate_limit": Entry(m14, "with recursive e as (select (epoch_us(ts)//1000)//86400000*100+user_id%100 caller, epoch_us(ts)//1000 ms, row_number() over (partition by (epoch_us(ts)//1000)//86400000*100+user_id%100 order by ts, event_id) i from events), s as (select caller, ms, i, true as ok, cast(1 as double) as rest from e where i=1 union all select e.caller, e.ms, e.i, least(2::double, rest+cast(e.ms-s.ms as double)/1000*(1::double/14400))>=1, least(2::double, rest+cast(e.ms-s.ms as double)/1000*(1::double/14400)) - case when least(2::double, rest+cast(e.ms-s.ms as double)/1000*(1::double/14400))>=1 then 1 else 0 end from s join e on e.caller=s.caller and e.i=s.i+1) select caller, count(*) requests, count(*) filter (not ok) refused from s group by 1"),
    "M15_budget_gate": Entry(m15, "with e as (select sum(cast(round(value*100) as bigint)) over (partition by user_id order by epoch_us(ts)//1000, event_id rows unbounded preceding) s from events) select case when s>=100000 then 'halt' when s>=90000 then 'degrade' when s>=70000 then 'warn' else 'normal' end state, count(*) n from e group by 1"),
    "A38_spend_counters": Entry(a38, "select strftime(ts,'%Y-%m-%d') as day, user_id session_id, cast(sum(cast(round(value*100) as bigint)) as bigint) cents from events group by 1,2"),
    "S05_tail": Entry(s05, "select event_id, event_type kind from events where event_id>floor((select max(event_id) from events)*0.9)"),
}
