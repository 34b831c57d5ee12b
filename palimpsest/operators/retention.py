"""Tiers, cohorts, pruning, compaction and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.sources.tables import AS_OF, NOW, events, table


def age_days(ts: str, now: str = NOW) -> Column:
    """Whole days from a timestamp without zone to ``now``."""
    return F.expr(f"timestampdiff(DAY, cast({ts} as timestamp_ntz), timestamp_ntz'{now}')")


def partition_action(age: Column, day_after: int, month_after: int, drop_after: int) -> Column:
    return F.when(age >= drop_after, "drop").when(age >= month_after, "compact_to_month").when(age >= day_after, "compact_to_day").otherwise("keep")


def d01(spark, sf_dir):
    """Hourly partitions of the orders with what is due for each: older hours first become days, then months."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    p = o.groupBy(F.date_format("ts", "yyyy/MM/dd/HH").alias("partition")).agg(F.count("*").alias("n"), F.date_trunc("hour", F.min("ts")).alias("start"))
    return p.select("partition", "n", partition_action(age_days("start", AS_OF), 90, 365, 1095).alias("action"))


def compact(df: DataFrame, path: str, by: list[str]) -> tuple[int, int]:
    """Write one file a partition and return (rows read, rows written); unequal counts are an error."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
    before, after = df.count(), df.sparkSession.read.parquet(path).count()
    if before != after:
        raise ValueError(f"compaction lost rows: {before} became {after}")
    return before, after


def d03(spark, sf_dir):
    """Rows past the limit go, unless a whitelist holds them."""
    o = table(spark, sf_dir, "orders")
    old = age_days("o_orderdate", AS_OF) > 3 * 365
    held = F.col("o_orderpriority").isin("1-URGENT") | (F.col("o_totalprice") > 400000)
    return o.groupBy(F.when(~old, "recent").when(held, "held").otherwise("dropped").alias("fate")).agg(F.count("*").alias("n"))


def tier(age: Column) -> Column:
    return F.when(age >= 25, "binary").when(age >= 12, "pq").otherwise("fp32")


def d04(spark, sf_dir):
    """Tier moves by kind; kinds that keep their vectors stay where they are."""
    ev = events(spark, sf_dir)
    to = F.when(F.col("kind").isin("click", "view", "error"), tier(age_days("ts"))).otherwise("fp32")
    return ev.groupBy("kind", to.alias("tier")).agg(F.count("*").alias("n"))


def demotion(age: Column) -> Column:
    return F.when(age < 7, "hot").when(age < 90, "warm").when(age < 365, "cold").otherwise("expired")


def d05(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", demotion(age_days("o_orderdate", AS_OF)).alias("tier")).agg(F.count("*").alias("n"))


def d06(spark, sf_dir):
    age = age_days("ts")
    return events(spark, sf_dir).groupBy("session_id").agg(F.count_if(age > 9).alias("hot_pruned"), F.count_if(age > 20).alias("cold_pruned"))


def d07(spark, sf_dir):
    """Ids of expired hours by partition, as one list a partition for deletion downstream."""
    ev = events(spark, sf_dir).withColumn("partition", F.date_format("ts", "yyyy/MM/dd/HH"))
    expired = F.expr(f"date_trunc('HOUR', ts) + interval 1 hour <= timestamp_ntz'{NOW}' - interval 20 days")
    return ev.filter(expired).groupBy("partition").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("event_id").alias("id_sum"))


def d08(spark, sf_dir):
    """Bodies of old rows are blanked; summaries of all are clipped."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    old = F.col("quality") == 0
    return d.select("doc_id", F.md5(F.when(old, F.lit("")).otherwise(F.col("text"))).alias("body"), F.md5(F.substring("text", 1, 1024)).alias("summary"))


def cohort(pii: Column, age: Column) -> Column:
    """Erasure by sensitivity: high after 30 days, medium and unknown after 90, low never."""
    return F.when(pii == "low", "keep").when((pii == "high") & (age >= 30), "erase_high").when((F.coalesce(pii, F.lit("")) != "high") & (age >= 90), F.when(pii == "medium", "erase_medium").otherwise("erase_unknown")).otherwise("keep")


def d09(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pii = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "5-LOW", "low")
    return o.groupBy(cohort(pii, age_days("o_orderdate", "1998-09-01 00:00:00")).alias("cohort")).agg(F.count("*").alias("n"))


def vacuum(blobs: DataFrame, refs: DataFrame, key: str, most: float = 0.5) -> DataFrame:
    """Blobs without a reference; none at all if that would delete more than ``most`` of them."""
    unused = blobs.join(refs, key, "left_anti")
    n = blobs.agg(F.count("*").alias("_all"))
    gone = unused.agg(F.count("*").alias("_gone"))
    return unused.join(F.broadcast(n)).join(F.broadcast(gone)).filter(F.col("_gone") <= most * F.col("_all")).drop("_all", "_gone")  # one row each


def d10(spark, sf_dir):
    parts, used = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return vacuum(parts, used, "p_partkey")


def d12(spark, sf_dir, n: int = 500):
    """The oldest deliveries before a date that are not archived yet."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate < '1997-01-01'")
    archived = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.join(archived, "o_orderkey", "left_anti").orderBy("o_orderdate", "o_orderkey").limit(n).select("o_orderkey", day.alias("day"))


def forget(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """What remains when all rows of some subjects are erased."""
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def d13(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return forget(table(spark, sf_dir, "orders"), gone, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def quantised(v: Column) -> Column:
    """(scale, codes): components as whole numbers of -127 to 127."""
    d = F.transform(v, lambda x: x.cast("double"))
    top = F.array_max(F.transform(d, F.abs))
    return F.struct((top / 127).alias("scale"), F.transform(d, lambda x: F.when(top > 0, F.round(x / top * 127)).otherwise(0.0).cast("int")).alias("codes"))


def d16(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("q"))
    total = F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + F.abs(x))
    return q.select("vec_id", F.round("q.scale", 8).alias("scale"), total.alias("weight"))


def d18(spark, sf_dir):
    """Jobs that are due: next run not after now, enabled, and not failing again and again."""
    jobs = events(spark, sf_dir).groupBy("session_id").agg(F.max("ms").alias("last"), F.max_by("kind", F.struct("ms", "event_id")).alias("outcome"), F.count_if(F.col("kind") == "error").alias("failures"))
    due = jobs.withColumn("next_ms", F.col("last") + (F.pmod("session_id", F.lit(5)) + 1) * 86400000)
    return due.filter((F.col("next_ms") <= 1706745600000) & (F.col("outcome") != "error")).select("session_id", "next_ms", "failures")


_AGE = "datediff('day', {c}, {now})"
_OD = "datediff('day', cast(o_orderdate as date), date '1998-06-01')"
_EA = "((epoch_us(timestamp '2024-02-01')-epoch_us(ts))//86400000000)"
ENTRIES = {
    "D01_partitions": Entry(d01, "with p as (select strftime(o_orderdate,'%Y/%m/%d/%H') as partition, count(*) n, date_trunc('hour',min(o_orderdate)::timestamp) s from orders group by 1) select partition, n, case when s<=timestamp '1998-06-01'-interval 1095 days then 'drop' when s<=timestamp '1998-06-01'-interval 365 days then 'compact_to_month' when s<=timestamp '1998-06-01'-interval 90 days then 'compact_to_day' else 'keep' end as action from p"),
    "D03_whitelisted_drop": Entry(d03, f"select case when {_OD}<=1095 then 'recent' when o_orderpriority='1-URGENT' or o_totalprice>400000 then 'held' else 'dropped' end fate, count(*) n from orders group by 1"),
    "D04_vector_tiers": Entry(d04, f"select event_type kind, case when event_type not in ('click','view','error') then 'fp32' when {_EA}>=25 then 'binary' when {_EA}>=12 then 'pq' else 'fp32' end tier, count(*) n from events group by 1,2"),
    "D05_demotion": Entry(d05, f"select o_orderstatus, case when {_OD}<7 then 'hot' when {_OD}<90 then 'warm' when {_OD}<365 then 'cold' else 'expired' end tier, count(*) n from orders group by 1,2"),
    "D06_prune": Entry(d06, f"select user_id session_id, count(*) filter ({_EA}>9) hot_pruned, count(*) filter ({_EA}>20) cold_pruned from events group by 1"),
    "D07_expired_ids": Entry(d07, "select strftime(ts,'%Y/%m/%d/%H') as partition, count(*) n, min(event_id) first_id, max(event_id) last_id, cast(sum(event_id) as bigint) id_sum from events where date_trunc('hour',ts)+interval 1 hour<=timestamp '2024-01-12' group by 1"),
    "D08_bodies": Entry(d08, "select doc_id, md5(case when quality=0 then '' else text end) body, md5(substr(text,1,1024)) summary from documents join labels using(doc_id)"),
    "D09_pii_cohorts": Entry(d09, "with o as (select case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' when '5-LOW' then 'low' end p, datediff('day', cast(o_orderdate as date), date '1998-09-01') a from orders) select case when p='low' then 'keep' when p='high' and a>=30 then 'erase_high' when coalesce(p,'')<>'high' and a>=90 then case when p='medium' then 'erase_medium' else 'erase_unknown' end else 'keep' end cohort, count(*) n from o group by 1"),
    "D10_vacuum": Entry(d10, "with u as (select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag='R' and l_quantity>30)) select * from u where (select count(*) from u)<=0.5*(select count(*) from part)"),
    "D12_audit_plan": Entry(d12, "select o_orderkey, strftime(o_orderdate,'%Y-%m-%d') as day from orders where o_orderdate<timestamp '1997-01-01' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag='R') order by o_orderdate, o_orderkey limit 500"),
    "D13_forget": Entry(d13, "select o_orderstatus, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_acctbal<0) group by 1"),
    "D16_quantised": Entry(d16, "with e as (select vec_id, unnest(embedding)::double x from embeddings), t as (select vec_id, max(abs(x)) m from e group by 1) select vec_id, round(any_value(m)/127,8) as scale, cast(sum(abs(round(x/m*127))) as bigint) weight from e join t using(vec_id) group by 1"),
    "D18_due_jobs": Entry(d18, "with j as (select user_id session_id, max(epoch_us(ts)//1000) l, arg_max(event_type,(epoch_us(ts)//1000,event_id)) o, count(*) filter (event_type='error') failures from events group by 1) select session_id, l+(session_id%5+1)*86400000 next_ms, failures from j where l+(session_id%5+1)*86400000<=1706745600000 and o<>'error'"),
}
