"""Dashboards and roll-ups over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.functions.records import SAID_SQL, TOPICS_SQL, said, topics
from palimpsest.sources.tables import NOW, events, table


_EV = "with ev as (select event_id, (epoch_us(ts)//1000) ms, ts, user_id session_id, event_type kind, value, cast(json_extract_string(props,'$.k') as int) k from events) "


def zero_filled(counts: DataFrame, spark: SparkSession, slot: str, n: int, value: str) -> DataFrame:
    """Every slot 0..n-1 with its value, 0 where there is none."""
    slots = spark.range(n).select(F.col("id").alias(slot))
    return slots.join(counts, slot, "left").select(slot, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def a01_overview(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def a02_minutes(spark, sf_dir, n: int = 1440):
    slot = F.least(F.floor((F.col("ms") - 1704067200000) / 60000), F.lit(n - 1)).alias("minute")
    counts = events(spark, sf_dir).groupBy(slot).agg(F.count("*").alias("events"))
    return zero_filled(counts, spark, "minute", n, "events")


def a03_days(spark, sf_dir):
    ev = events(spark, sf_dir).filter("kind = 'error'")
    day = F.floor((F.col("ms") - 1706054400000) / 86400000).alias("day")  # the week from 2024-01-24
    return zero_filled(ev.groupBy(day).agg(F.count("*").alias("errors")).filter("day between 0 and 6"), spark, "day", 7, "errors")


def a04_p95(spark, sf_dir):
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
    return events(spark, sf_dir).groupBy(hour).agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


def a05_cost(spark, sf_dir):
    hour = F.hour("ts").cast("long").alias("hour")
    cents = events(spark, sf_dir).groupBy(hour).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return zero_filled(cents, spark, "hour", 24, "cents")


def a06_usage(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("calls"))
    return n.withColumn("share", F.round(F.col("calls") / F.sum("calls").over(Window.partitionBy()), 6))


def a07_heatmap(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def a08_sessions(spark, sf_dir):
    ev = events(spark, sf_dir)
    first = F.min_by("kind", F.struct("ms", "event_id")).alias("first_kind")
    return ev.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), (F.max("ms") - F.min("ms")).alias("duration_ms"), F.countDistinct("kind").alias("kinds"), first)


def a09_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"), F.sum((F.col("role") == "system").cast("long")).alias("system_turns"), F.min_by("role", "turn").alias("first_role"))


def a10_facets(spark, sf_dir, most: int = 40):
    """Facets of what is said in two languages: the ``most`` frequent topics, severities, risks and sources."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").filter("lang in ('en', 'de')").join(marks, "doc_id", "left")
    d = d.select(topics(said()).alias("topics"), F.when(F.col("toxic") == 1, "critical").otherwise("info").alias("severity"), F.when(F.contains("text", F.lit("@")), "high").otherwise("low").alias("pii"), "source")
    each = d.select(F.explode(F.flatten(F.array(F.transform("topics", lambda t: F.struct(F.lit("topic").alias("facet"), t.alias("value"))), F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("severity", "pii", "source")])))).alias("f"))
    counts = each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter((F.col("facet") != "topic") | (F.col("place") <= most)).drop("place")


def a11_catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("title"), F.count("*").alias("n"))


def a12_touched(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda flag: F.sum((F.col("l_returnflag") == flag).cast("long"))
    return li.groupBy("l_partkey").agg(side("R").alias("reads"), side("A").alias("writes"), side("N").alias("others"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"))


def a13_axes(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    n = ev.cube("kind", "day").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.grouping_id().cast("long").alias("level"))
    return n.select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("day", F.lit("unknown")).alias("day"), "n", "sessions", "level")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on ties."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("votes"))


def a14_majority(spark, sf_dir):
    return majority(events(spark, sf_dir), "session_id", "kind")


def iso_week(ts: str):
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col(ts)).cast("int"), F.weekofyear(ts))


def digest_buckets(ev: DataFrame, by: list[str], now: str = NOW, age_days: int = 7, least: int = 5, done: DataFrame | None = None) -> DataFrame:
    """Members of each (``by``, ISO week) bucket of events older than ``age_days``, with its size; buckets of fewer than
    ``least`` are left out, and so are the events (event_id) of ``done``. One row an event, so that no bucket has to fit
    one row."""
    old = ev.filter(F.col("ts") < F.expr(f"timestamp_ntz'{now}' - interval {age_days} days")).withColumn("week", iso_week("ts"))
    if done is not None:
        old = old.join(done.select("event_id").distinct(), "event_id", "left_anti")
    sizes = old.groupBy("week", *by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return old.join(sizes, ["week", *by]).select(*by, "week", "n", "event_id")


def a16_digests(spark, sf_dir):
    """Events of more than thirty days by session, week and kind, without those that were summarised before."""
    done = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"))
    return digest_buckets(events(spark, sf_dir), ["session_id", "kind"], "2024-02-25 00:00:00", 30, 5, done)


def a17_tool_digests(spark, sf_dir):
    """By tool, of what succeeded."""
    calls = events(spark, sf_dir).filter("outcome = 'success'").select("ts", "event_id", F.col("kind").alias("tool"), F.expr("k div 10").alias("repo"))
    return digest_buckets(calls, ["repo", "tool"])


def a18_daily(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def a19_monthly(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.coalesce("o_orderpriority", F.lit("")).alias("tool")).agg(F.count("*").alias("n"))


def a20_spend(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def a21_status(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count("*").alias("records"), F.countDistinct("session_id").alias("repositories"), F.count_if(F.col("kind") == "click").alias("events"), (F.count("*") - F.count_if(F.col("kind") == "click")).alias("memories"))


def a22_inventory(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    orders = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("links"))
    per = c.join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("records"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    return per


def a23_audit(spark, sf_dir, newest: int = 5000):
    ev = events(spark, sf_dir).orderBy(F.desc("ms"), F.desc("event_id")).limit(newest)
    return ev.agg(F.count("*").alias("attempts"), F.count_if(F.col("kind") == "purchase").alias("prepared"), F.count_if(F.col("kind") == "error").alias("errors"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("session_id").alias("sessions"))


def a24_feedback(spark, sf_dir):
    fb = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return fb.groupBy("source", "lang").agg(F.bool_or(F.col("quality") == 1).alias("helpful"), F.bool_or(F.col("toxic") == 1).alias("unhelpful"), F.min("doc_id").alias("earliest"))


def a25_conflicts(spark, sf_dir):
    return a24_feedback(spark, sf_dir).filter("helpful and unhelpful").select("source", "lang", "earliest")


def a29_ages(spark, sf_dir):
    age = F.floor((F.lit(1706745600000) - F.col("ms")) / 86400000)
    band = F.when(age <= 7, "week").when(age <= 21, "three_weeks").otherwise("older").alias("band")
    return events(spark, sf_dir).groupBy(band).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("size"))


def a30_blobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))
    return d.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.count("*").alias("refs")).agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"), F.sum("refs").alias("refs"))


def a33_copies(spark, sf_dir):
    """Documents whose text another one has too, with the number of its holders."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "hash").select("hash", "n", "doc_id")


def a36_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))


def a37_cents(spark, sf_dir):
    tokens = F.ceil(F.length("text") / 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.floor((tokens * 150 + 999999) / 1000000).alias("cents"))


def a39_denials(spark, sf_dir):
    slot = F.floor(F.col("ms") / 300000).alias("slot")
    return events(spark, sf_dir).groupBy(slot).agg(F.count_if(F.col("kind") == "error").alias("denied"), F.count("*").alias("evaluated"))


def a40_denied(spark, sf_dir, n: int = 10):
    ev = events(spark, sf_dir).filter("kind = 'error'").groupBy("session_id").agg(F.count("*").alias("denied"))
    return ev.orderBy(F.desc("denied"), "session_id").limit(n)


def a41_freshness(spark, sf_dir):
    last = events(spark, sf_dir).groupBy("session_id").agg(F.max("ms").alias("ms"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    gap = F.when(F.col("ms").isNull(), -1).otherwise(F.floor((F.lit(1706745600000) - F.col("ms")) / 1000))
    level = F.when(F.col("gap") < 0, "warn").when(F.col("gap") > 172800, "critical").when(F.col("gap") > 100000, "warn").otherwise("ok")
    return users.join(last, "session_id", "left").select("session_id", gap.cast("long").alias("gap")).withColumn("severity", level)


def a43_archive(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy/MM/dd").alias("partition"), "kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_DAYS = "strftime(ts,'%Y-%m-%d')"
_A10 = f"with x as (select doc_id, max(toxic) toxic from labels group by 1), d as (select doc_id, text, source, {SAID_SQL} t, toxic from documents left join x using(doc_id) where lang in ('en','de')), u as (select 'topic' facet, unnest({TOPICS_SQL}) as value from d union all select 'severity', case when toxic=1 then 'critical' else 'info' end from d union all select 'pii', case when contains(text,'@') then 'high' else 'low' end from d union all select 'source', source from d) select facet, value, count(*) n from u group by 1,2 qualify facet<>'topic' or row_number() over (partition by facet order by count(*) desc, value)<=40"
ENTRIES = {
    "A01_overview": Entry(a01_overview, "select coalesce(event_type,'total') kind, count(*) n from events group by rollup(event_type)"),
    "A02_minute_series": Entry(a02_minutes, _EV + ", c as (select least((ms-1704067200000)//60000,1439) m, count(*) n from ev group by 1) select r.range as minute, cast(coalesce(n,0) as bigint) as events from range(1440) r left join c on c.m=r.range"),
    "A03_daily_errors": Entry(a03_days, _EV + ", c as (select (ms-1706054400000)//86400000 d, count(*) n from ev where kind='error' and ms>=1706054400000 group by 1) select r.range as day, cast(coalesce(n,0) as bigint) as errors from range(7) r left join c on c.d=r.range"),
    "A04_p95": Entry(a04_p95, "select strftime(ts,'%Y-%m-%d %H') as hour, round(quantile_cont(value,0.95),6) p95 from events group by 1"),
    "A05_cost_ribbon": Entry(a05_cost, "with c as (select cast(hour(ts) as bigint) h, sum(cast(round(value*100) as bigint)) s from events group by 1) select r.range as hour, cast(coalesce(s,0) as bigint) as cents from range(24) r left join c on c.h=r.range"),
    "A06_usage": Entry(a06_usage, "select event_type kind, count(*) calls, round(count(*)/sum(count(*)) over (),6) as share from events group by 1"),
    "A07_heatmap": Entry(a07_heatmap, "select cast(isodow(ts)-1 as bigint) weekday, cast(hour(ts) as bigint) as hour, count(*) n from events group by 1,2"),
    "A08_sessions": Entry(a08_sessions, _EV + "select session_id, count(*) n, min(ms) first_ms, max(ms) last_ms, max(ms)-min(ms) duration_ms, count(distinct kind) kinds, arg_min(kind, (ms,event_id)) first_kind from ev group by 1"),
    "A09_conversations": Entry(a09_conversations, "select conv_id, count(distinct turn) turns, cast(sum(case when role='system' then 1 else 0 end) as bigint) system_turns, arg_min(role,turn) first_role from conversations group by 1"),
    "A10_facets": Entry(a10_facets, _A10),
    "A11_catalogue": Entry(a11_catalogue, "select p_brand, arg_min(p_name,p_partkey) title, count(*) n from part group by 1"),
    "A12_touched": Entry(a12_touched, "select l_partkey, count(*) filter (l_returnflag='R') as reads, count(*) filter (l_returnflag='A') as writes, count(*) filter (l_returnflag='N') as others, strftime(max(l_shipdate),'%Y-%m-%d') as last from lineitem group by 1"),
    "A13_axes": Entry(a13_axes, f"with e as (select *, {_DAYS} as day from events) select coalesce(event_type,'unknown') kind, coalesce(day,'unknown') as day, count(*) n, count(distinct user_id) sessions, grouping_id(event_type, day) as level from e group by cube(event_type, day)"),
    "A14_majority": Entry(a14_majority, "with c as (select user_id, event_type, count(*) n from events group by 1,2) select user_id session_id, arg_min(event_type, (-n, event_type)) kind, max(n) votes from c group by 1"),
    "A16_digest_buckets": Entry(a16_digests, "select user_id session_id, event_type kind, strftime(ts,'%G-W%V') as week, count(*) over (partition by user_id, event_type, strftime(ts,'%G-W%V')) n, event_id from events where ts < timestamp '2024-01-26 00:00:00' and event_id not in (select conv_id from conversations where conv_id is not null) qualify n>=5"),
    "A17_tool_digests": Entry(a17_tool_digests, "select cast(json_extract_string(props,'$.k') as bigint)//10 repo, event_type tool, strftime(ts,'%G-W%V') as week, count(*) over (partition by cast(json_extract_string(props,'$.k') as bigint)//10, event_type, strftime(ts,'%G-W%V')) n, event_id from events where event_type<>'error' and ts < timestamp '2024-01-25 00:00:00' qualify n>=5"),
    "A18_daily": Entry(a18_daily, f"select {_DAYS} as day, event_type kind, count(*) n, round(sum(value),2) as value from events group by 1,2"),
    "A19_monthly": Entry(a19_monthly, "select strftime(o_orderdate,'%Y-%m') as month, coalesce(o_orderpriority,'') tool, count(*) n from orders group by 1,2"),
    "A20_spend": Entry(a20_spend, "select strftime(o_orderdate,'%Y-%m') as month, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) cents from orders group by 1"),
    "A21_status": Entry(a21_status, "select count(*) records, count(distinct user_id) repositories, count(*) filter (event_type='click') as events, count(*) filter (event_type<>'click') as memories from events"),
    "A22_inventory": Entry(a22_inventory, "with o as (select o_custkey, count(*) links from orders group by 1) select c_nationkey, count(*) records, cast(sum(coalesce(links,0)) as bigint) links from customer left join o on o_custkey=c_custkey group by 1"),
    "A23_audit": Entry(a23_audit, "with e as (select * from events order by (epoch_us(ts)//1000) desc, event_id desc limit 5000) select count(*) attempts, count(*) filter (event_type='purchase') as prepared, count(*) filter (event_type='error') as errors, min(value) low, max(value) high, round(sum(value),2) total, count(distinct user_id) sessions from e"),
    "A24_feedback": Entry(a24_feedback, "select source, lang, bool_or(quality=1) helpful, bool_or(toxic=1) unhelpful, min(doc_id) earliest from labels join documents using(doc_id) group by 1,2"),
    "A25_conflicts": Entry(a25_conflicts, "select source, lang, min(doc_id) earliest from labels join documents using(doc_id) group by 1,2 having bool_or(quality=1) and bool_or(toxic=1)"),
    "A29_ages": Entry(a29_ages, "select case when (1706745600000-(epoch_us(ts)//1000))//86400000<=7 then 'week' when (1706745600000-(epoch_us(ts)//1000))//86400000<=21 then 'three_weeks' else 'older' end band, count(*) n, round(sum(value),2) as size from events group by 1"),
    "A30_blobs": Entry(a30_blobs, "with d as (select sha256(text) h, any_value(octet_length(encode(text))) b, count(*) r from documents group by 1) select count(*) blobs, cast(sum(b) as bigint) bytes, cast(sum(r) as bigint) refs from d"),
    "A33_copies": Entry(a33_copies, "select sha256(text) hash, count(*) over (partition by sha256(text)) n, doc_id from documents where text is not null qualify n>1"),
    "A36_estimate": Entry(a36_estimate, "select source, count(*) files, cast(sum(ceil(length(text)/4)) as bigint) tokens from documents group by 1"),
    "A37_cents": Entry(a37_cents, "select doc_id, cast((cast(ceil(length(text)/4) as bigint)*150+999999)//1000000 as bigint) cents from documents"),
    "A39_denials": Entry(a39_denials, "select (epoch_us(ts)//1000)//300000 slot, count(*) filter (event_type='error') as denied, count(*) evaluated from events group by 1"),
    "A40_denied": Entry(a40_denied, "select user_id session_id, count(*) denied from events where event_type='error' group by 1 order by 2 desc, 1 limit 10"),
    "A41_freshness": Entry(a41_freshness, "with l as (select user_id, max((epoch_us(ts)//1000)) ms from events group by 1), g as (select c_custkey session_id, case when ms is null then -1 else (1706745600000-ms)//1000 end gap from customer left join l on user_id=c_custkey) select session_id, cast(gap as bigint) gap, case when gap<0 then 'warn' when gap>172800 then 'critical' when gap>100000 then 'warn' else 'ok' end severity from g"),
    "A43_archive": Entry(a43_archive, "select strftime(ts,'%Y/%m/%d') as partition, event_type kind, count(*) n, min(event_id) first_id, max(event_id) last_id from events group by 1,2"),
}
