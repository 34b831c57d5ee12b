"""Triggers by keyed state and timers, sessions behind a watermark, and graph nodes merged from micro-batches.

All flows here append: what is out is never rewritten, and state goes when a key's timer fires or the watermark has
passed it.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.catalog import Entry
from palimpsest.sources.shared import remove
from palimpsest.streaming.flows import event_stream, run_to_end, session_ends, work_dir

# Quiet minutes that end a session, events that make a topic due.
IDLE_MINUTES, DUE = 30, 8
TRIGGERS = "session_id long, trigger string, n long, at_ms long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged_spans(spans: list[tuple[int, int, int]], idle: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of sessions: spans less than ``idle`` apart, or just so far, are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= idle:
            a, b, m = out.pop()
            first, last, n = a, max(b, last), m + n
        out.append((first, last, n))
    return out


class SessionTriggers(StatefulProcessor):
    """For each session: a decision at once, a topic whenever ``due`` more events are there, the end when it was quiet.

    What is counted towards a topic goes when the topic fires. Of what is not over yet the spans between rests are held,
    with a timer for the first; once the watermark has passed a span, nothing can join it any more: it is out and forgotten.
    So files may come in any order within the watermark. A call reads and writes a session's state once, however many of
    its spans are over.
    """

    def __init__(self, decisions: str, due: int = DUE, idle_ms: int = IDLE_MINUTES * 60_000):
        self.decisions, self.due, self.idle_ms = decisions, due, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.towards = handle.getValueState("towards", "n long")
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        before = self.towards.get()
        towards = before[0] if before else 0
        held = [tuple(r) for r in self.open.get()]
        spans, out = held, []
        for b in rows:
            landed = b[b["kind"] == self.decisions]
            out += [("decision_landed", n, at) for n, at in zip(landed["event_id"].tolist(), landed["ms"].tolist())]
            fired, towards = divmod(towards + len(b), self.due)
            out += [("topic_due", self.due, int(b["ms"].max()))] * fired
            spans = merged_spans(spans + [(t, t, 1) for t in b["ms"].tolist() if t >= passed], self.idle_ms)
        if towards:
            self.towards.update((towards,))
        elif before:
            self.towards.clear()
        if spans != held:
            # one timer a session, for the span that ends first: those that are over by then leave together
            self._wait(held, spans)
            self.open.put(spans)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = [tuple(r) for r in self.open.get()]
        over = [s for s in spans if s[1] + self.idle_ms < limit]
        left = [s for s in spans if s[1] + self.idle_ms >= limit]
        if left:
            self._wait([], left)
            self.open.put(left)
        else:
            self.open.clear()
        if over:
            yield self._rows(key, [("session_end", n, last) for _, last, n in over])

    def _wait(self, held: list, spans: list) -> None:
        """Have the timer stand at the end of the first of ``spans``; it stood at that of the first of ``held``."""
        was, due = (x[0][1] + self.idle_ms + 1 if x else None for x in (held, spans))
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(due)

    def _rows(self, key, found: list[tuple[str, int, int]]) -> pd.DataFrame:
        trigger, n, at = zip(*found)
        # text as objects: the serializer takes no chunked strings
        return pd.DataFrame({"session_id": [key[0]] * len(n), "trigger": pd.Series(trigger, dtype=object), "n": n, "at_ms": at})

    def close(self) -> None:
        pass


def session_triggers(stream: DataFrame, late: str, decisions: str = "purchase", due: int = DUE, idle_ms: int = IDLE_MINUTES * 60_000) -> DataFrame:
    """(session_id, trigger, n, at_ms) of a stream (event_id, ts, session_id, kind): n is the event of a decision, the
    events that made a topic due, or the events of the session. Sessions end when the watermark, ``late`` behind, has passed."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).filter("session_id is not null")
    return rows.groupBy("session_id").transformWithStateInPandas(SessionTriggers(decisions, due, idle_ms), TRIGGERS, "append", "eventTime")


def merged_nodes(stream: DataFrame, keys: list[str], order: str, base: str | None = None, buckets: int = 32) -> DataFrame:
    """The latest row of each key by ``order``: micro-batches are coalesced, then merged into the buckets they touch.

    A bucket has one version a batch that touched it, and the newest counts, so that no more is read or written than the
    batch's own buckets hold, a batch that is run again replaces its versions, and readers never see half a merge.
    """
    spark = stream.sparkSession
    if base is None:
        base = work_dir(spark)
        atexit.register(remove, spark, base)
    columns = stream.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes) + ", batch long, bucket int"
    struct = F.struct(*columns)

    def newest(df: DataFrame, upto: int | None = None) -> DataFrame:
        """Rows of each bucket's newest version (before ``upto``)."""
        if upto is not None:
            df = df.filter(F.col("batch") < upto)
        versions = df.select("batch", "bucket").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
        return df.join(F.broadcast(versions), ["batch", "bucket"])  # a row a bucket

    def merge(batch: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = batch.groupBy(*keys).agg(F.max_by(struct, order).alias("row")).select("row.*").withColumn("bucket", bucket).persist()
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if n and touched:
            held = newest(batch.sparkSession.read.schema(schema).parquet(f"{base}/out").filter(F.col("bucket").isin(touched)), n)
            fresh_and_held = fresh.unionByName(held.select(*columns, "bucket"))
            out = fresh_and_held.groupBy("bucket", *keys).agg(F.max_by(struct, order).alias("row")).select("row.*", "bucket")
        else:
            out = fresh
        out.write.partitionBy("bucket").mode("overwrite").parquet(f"{base}/out/batch={n}")
        fresh.unpersist()

    spark.createDataFrame([], stream.schema).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").mode("append").parquet(f"{base}/out/batch=-1")
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return newest(spark.read.schema(schema).parquet(f"{base}/out")).select(*columns)


def m04(spark, sf_dir):
    """Sessions that the watermark, an hour behind, has passed; the others are still open."""
    return run_to_end(session_ends(event_stream(spark, sf_dir), "30 minutes", "1 hour"), "append")


def m05(spark, sf_dir):
    """Both triggers, and ends of sessions, of the whole log."""
    found = run_to_end(session_triggers(event_stream(spark, sf_dir), "1 hour"), "append")
    return found.filter("trigger <> 'session_end'").select("session_id", "trigger", "n")


def m08(spark, sf_dir):
    """Nodes of the graph: the value of the latest event of each session and kind."""
    stream = event_stream(spark, sf_dir).select("session_id", "kind", "value", "event_id")
    return merged_nodes(stream, ["session_id", "kind"], "event_id").select("session_id", "kind", "value")


ENTRIES = {
    "M04_closed_sessions": Entry(m04, "with a as (select user_id, ts, case when ts-lag(ts) over w<interval 30 minutes then 0 else 1 end nw from events window w as (partition by user_id order by ts)), b as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) v from a) select user_id session_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as start, count(*) n from b group by user_id, v having epoch_ms(max(ts)) + 1800000 <= (select max(epoch_ms(ts)) - 3600000 from events)"),
    "M05_triggers": Entry(m05, "select user_id session_id, 'decision_landed' as trigger, event_id n from events where event_type='purchase' union all select user_id, 'topic_due', unnest(list_transform(range(count(*)//8), lambda x: 8::bigint)) from events group by 1"),
    "M08_merged_nodes": Entry(m08, "select user_id session_id, event_type kind, arg_max(value,event_id) as value from events group by 1,2"),
}
