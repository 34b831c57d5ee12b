"""As-of classification, branches, timelines and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.operators.joins import revisions
from palimpsest.sources.shared import spread
from palimpsest.sources.tables import AS_OF, events, table


def temporal_state(t: Column, *, valid_from="valid_from", valid_to="valid_to", superseded_at="superseded_at", lifecycle="lifecycle", soon_days: int = 30) -> Column:
    """State of a fact at the date ``t``; the first rule that holds counts."""
    return (
        F.when(F.col(superseded_at) <= t, "superseded")
        .when(F.col(valid_to) <= t, "expired")
        .when(F.col(valid_from) > t, "not_yet_valid")
        .when(F.col(lifecycle) == "abandoned", "abandoned")
        .when(F.col(valid_to) <= F.date_add(t, soon_days), "temporal")
        .otherwise("valid")
    )


def temporal_multiplier(state: Column, include_history=False, include_future=False, include_branches=False) -> Column:
    """Factor of a score by state; null: the fact is dropped."""
    none = F.lit(None).cast("double")
    return (
        F.when(state.isin("superseded", "expired"), F.lit(0.5) if include_history else none)
        .when(state == "not_yet_valid", F.lit(1.0) if include_future else none)
        .when(state == "abandoned", F.lit(1.0) if include_branches else none)
        .when(state == "temporal", 1.10)
        .otherwise(1.0)
    )


def facts(spark, sf_dir) -> DataFrame:
    """Orders as facts about customers: a later order supersedes, finished ones run out after 120 days."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("subject"),
        day.alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(day, 120)).alias("valid_to"),
        F.lead(day).over(w).alias("superseded_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "abandoned").otherwise("active").alias("lifecycle"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("score"),
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz").cast("date")


def t01(spark, sf_dir):
    return facts(spark, sf_dir).select("id", temporal_state(_as_of()).alias("state"))


def t02(spark, sf_dir):
    state = temporal_state(_as_of())
    f = facts(spark, sf_dir).withColumn("factor", temporal_multiplier(state, include_history=True))
    return f.groupBy(state.alias("state"), "factor").agg(F.count("*").alias("n"))


def t03(spark, sf_dir, n: int = 100):
    state = temporal_state(_as_of())
    f = facts(spark, sf_dir).withColumn("score", F.round(F.col("score") * temporal_multiplier(state, include_branches=True), 6))
    return f.filter("score is not null").orderBy(F.desc("score"), "id").limit(n).select("id", "score")


def ancestry(parents: DataFrame, doublings: int = 4) -> DataFrame:
    """(node, ancestor, depth) within 2^doublings steps of (node, parent), the nearest depth of each; cycles end there.

    Each join doubles the distance covered, so the number of joins is the logarithm of the depth.
    """
    known = parents.filter("parent is not null and parent <> node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    n = known.count()
    for k in range(doublings):
        # with one parent a node a join yields up to 2^k ancestors of each, so it is dealt out by these
        rows = n * 2 ** (k + 1)
        far = spread(known.filter(F.col("depth") == 2**k).select("node", F.col("ancestor").alias("via"), F.col("depth").alias("near")), rows, "via")
        on = spread(known.select(F.col("node").alias("via"), "ancestor", "depth"), rows, "via")
        longer = far.join(on, "via").select("node", "ancestor", (F.col("near") + F.col("depth")).alias("depth")).filter("node <> ancestor")
        known = spread(known.unionByName(longer), rows, "node").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    return known


def t04(spark, sf_dir):
    key = F.col("p_partkey")
    parents = table(spark, sf_dir, "part").select(key.alias("node"), F.when(key > 0, F.floor(key / 4)).alias("parent"))
    return ancestry(parents)


def stamped(df: DataFrame, recorded: Column, created: Column) -> DataFrame:
    """Valid and recorded times where they are absent."""
    return df.withColumns({"recorded_at": F.coalesce(recorded, created), "valid_from": F.coalesce("valid_from", recorded, created)})


def t05(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("first")), "c_custkey", "left")
    s = stamped(c.withColumn("valid_from", F.when(F.col("c_acctbal") > 0, F.lit("1992-01-01").cast("date"))), F.col("first"), F.lit("1970-01-01").cast("date"))
    return s.select("c_custkey", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def t06(spark, sf_dir, n: int = 200):
    """Timeline: kind and span on valid time, as_of on recorded time, newest first."""
    ev = events(spark, sf_dir).filter(F.col("kind").isin("purchase", "signup") & F.col("ms").between(1704844800000, 1706054400000) & (F.col("ms") <= 1705968000000))
    return ev.orderBy(F.desc("ms"), F.desc("event_id")).limit(n).select("event_id", "kind", "ms")


def t07(spark, sf_dir):
    w = Window.partitionBy("id").orderBy("revision")
    r = revisions(spark, sf_dir)
    return r.select("id", "revision", "status", F.round(F.col("amount") - F.lag("amount").over(w), 2).alias("change"))


def t08(spark, sf_dir):
    """Branch states: the latest status row of each branch, customers' orders as status rows."""
    last = revisions(spark, sf_dir).groupBy("id").agg(F.max_by("status", "revision").alias("status"), F.count("*").alias("changes"))
    name = F.when(F.col("status") == "F", "merged").when(F.col("status") == "P", "abandoned").otherwise("open")
    return last.select("id", name.alias("state"), "changes")


def t09(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("ms", "event_id")
    title = F.concat_ws(" ", "kind", F.format_string("%d", "k"))
    return events(spark, sf_dir).select("session_id", F.row_number().over(w).alias("pos"), "event_id", title.alias("title"), (F.col("ms") - F.first("ms").over(w)).alias("offset_ms"))


def accepted_revisions(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals (id, expected, ...) whose expected revision is the current one (0: none); of several, the smallest proposal wins."""
    at = current.select("id", "revision")
    ok = proposed.join(at, "id", "left").filter(F.col("expected") == F.coalesce("revision", F.lit(0)))
    w = Window.partitionBy("id").orderBy("proposal")
    return ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "proposal", (F.col("expected") + 1).alias("revision"))


def t10(spark, sf_dir):
    current = revisions(spark, sf_dir).groupBy("id").agg(F.max("revision").alias("revision"))
    ev = events(spark, sf_dir)
    proposed = ev.select(F.col("session_id").alias("id"), F.col("event_id").alias("proposal"), F.col("k").alias("expected"))
    return accepted_revisions(current, proposed)


def t11(spark, sf_dir):
    """Whether a topic card is due: enough events, a high one close to it, or age; the first reason counts."""
    s = events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.max("value").alias("impact"), F.max("ms").alias("last"))
    age = F.floor((F.lit(1706745600000) - F.col("last")) / 86400000)
    reason = F.when(F.col("n") >= 80, "events").when(F.col("impact") > 200, "impact").when(age >= 14, "age").otherwise("hold")
    return s.select("session_id", reason.alias("reason"))


_F = (
    "with f as (select o_orderkey id, o_custkey subject, cast(o_orderdate as date) valid_from, case when o_orderstatus='F' then cast(o_orderdate as date)+120 end valid_to, "
    "lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) superseded_at, case when o_orderpriority='5-LOW' then 'abandoned' else 'active' end lifecycle, round(o_totalprice/1000,3) score from orders), "
    "s as (select *, case when superseded_at<=date '1998-06-01' then 'superseded' when valid_to<=date '1998-06-01' then 'expired' when valid_from>date '1998-06-01' then 'not_yet_valid' when lifecycle='abandoned' then 'abandoned' when valid_to<=date '1998-07-01' then 'temporal' else 'valid' end state from f) "
)
_R = "with r as (select o_custkey id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) revision, o_orderstatus status, round(o_totalprice,2) amount from orders) "
ENTRIES = {
    "T01_as_of": Entry(t01, _F + "select id, state from s"),
    "T02_actions": Entry(t02, _F + "select state, case when state in ('superseded','expired') then 0.5 when state in ('not_yet_valid','abandoned') then null when state='temporal' then 1.1 else 1.0 end::double factor, count(*) n from s group by 1,2"),
    "T03_rescored": Entry(t03, _F + "select id, round(score*case when state='temporal' then 1.1 else 1.0 end,6) score from s where state in ('temporal','valid','abandoned') order by 2 desc, 1 limit 100"),
    "T04_ancestry": Entry(t04, "with recursive a(node, ancestor, depth) as (select p_partkey, p_partkey//4, 1 from part where p_partkey>0 union all select node, ancestor//4, depth+1 from a where ancestor>0) select node, ancestor, depth from a where node<>ancestor"),
    "T05_stamped": Entry(t05, "with o as (select o_custkey, min(cast(o_orderdate as date)) f from orders group by 1) select c_custkey, strftime(coalesce(f, date '1970-01-01'),'%Y-%m-%d') recorded_at, strftime(case when c_acctbal>0 then date '1992-01-01' else coalesce(f, date '1970-01-01') end,'%Y-%m-%d') valid_from from customer left join o on o_custkey=c_custkey"),
    "T06_timeline": Entry(t06, "select event_id, event_type kind, epoch_us(ts)//1000 ms from events where event_type in ('purchase','signup') and epoch_us(ts)//1000 between 1704844800000 and 1706054400000 and epoch_us(ts)//1000<=1705968000000 order by 3 desc, 1 desc limit 200"),
    "T07_history": Entry(t07, _R + "select id, revision, status, round(amount-lag(amount) over (partition by id order by revision),2) as change from r"),
    "T08_branches": Entry(t08, _R + "select id, case arg_max(status,revision) when 'F' then 'merged' when 'P' then 'abandoned' else 'open' end state, count(*) as changes from r group by 1"),
    "T09_session_rows": Entry(t09, "select user_id session_id, row_number() over w pos, event_id, event_type || ' ' || json_extract_string(props,'$.k') title, epoch_us(ts)//1000-first_value(epoch_us(ts)//1000) over w offset_ms from events window w as (partition by user_id order by epoch_us(ts)//1000, event_id)"),
    "T10_accepted": Entry(t10, "with c as (select o_custkey id, count(*) revision from orders group by 1), p as (select user_id id, event_id proposal, cast(json_extract_string(props,'$.k') as int) expected from events) select p.id, min(proposal) proposal, any_value(expected)+1 revision from p left join c using(id) where expected=coalesce(revision,0) group by 1"),
    "T11_card_due": Entry(t11, "with s as (select user_id session_id, count(*) n, max(value) impact, max(epoch_us(ts)//1000) l from events group by 1) select session_id, case when n>=80 then 'events' when impact>200 then 'impact' when (1706745600000-l)//86400000>=14 then 'age' else 'hold' end reason from s"),
}
