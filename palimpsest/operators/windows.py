"""Ranking and running operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.operators.joins import revisions
from palimpsest.sources.tables import events, table


def w01(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("rank")).filter("rank <= 20")


def w02(spark, sf_dir):
    w = Window.partitionBy("id").orderBy(F.desc("revision"))
    return revisions(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "revision", "amount")


def first_anchor(hits: DataFrame, anchor: list[str], order: list) -> DataFrame:
    """The best hit of each anchor."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*anchor).orderBy(*order))).filter("_n = 1").drop("_n")


def w03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return first_anchor(d, ["source", "lang"], [F.desc("n_chars"), "doc_id"])


def sessions(ev: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """Events with the number of their session: a gap over ``idle_ms`` starts another."""
    w = Window.partitionBy("session_id").orderBy("ms", "event_id")
    new = F.coalesce((F.col("ms") - F.lag("ms").over(w) > idle_ms).cast("int"), F.lit(1))
    return ev.withColumn("_new", new).withColumn("visit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def w05(spark, sf_dir):
    s = sessions(events(spark, sf_dir))
    return s.groupBy("session_id", "visit").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def w06(spark, sf_dir, after: tuple[int, int] = (1706000000000, 0), n: int = 25):
    ev = events(spark, sf_dir).filter((F.col("ms") < after[0]) | ((F.col("ms") == after[0]) & (F.col("event_id") > after[1])))
    return ev.orderBy(F.desc("ms"), "event_id").limit(n + 1).select("event_id", "ms")


def alert_states(levels: DataFrame, key: str, order: str, level: str, warn_after: int = 2, recover_after: int = 5) -> DataFrame:
    """``levels`` with the state after each poll: critical at once, warning after ``warn_after`` polls in a row that are
    not well (never in place of critical), well again after ``recover_after`` well polls in a row.

    Critical polls and recoveries settle the state alone; between two of them only a warning can change it.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    well = F.col(level) == "ok"
    runs = levels.withColumn("_well", well).withColumn("_turn", F.coalesce((F.col("_well") != F.lag("_well").over(w)).cast("int"), F.lit(0)))
    runs = runs.withColumn("_run", F.sum("_turn").over(so_far))
    runs = runs.withColumn("_length", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)))
    settled = F.when(F.col(level) == "critical", "critical").when(F.col("_well") & (F.col("_length") >= recover_after), "ok")
    runs = runs.withColumn("_settled", settled).withColumn("_base", F.last("_settled", ignorenulls=True).over(so_far))
    runs = runs.withColumn("_part", F.count("_settled").over(so_far))
    fires = (F.col(level) == "warn") & (F.col("_length") >= warn_after)
    fired = F.max(fires).over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("_base") == "critical", "critical").when(fired, "warn").otherwise("ok")
    return runs.withColumn("state", state).drop("_well", "_turn", "_run", "_length", "_settled", "_base", "_part")


def w07(spark, sf_dir):
    ev = events(spark, sf_dir)
    level = F.when(F.col("kind") == "error", "critical").when(F.col("value") > 60, "warn").otherwise("ok")
    return alert_states(ev.select("session_id", "event_id", level.alias("level")), "session_id", "event_id", "level")


def budgeted(df: DataFrame, size: str, order: list, budget: int, key: str) -> DataFrame:
    """Rows of each key, in order, while their running size stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def w09(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return budgeted(d, "bytes", ["doc_id"], 40000, "source")


def w08(spark, sf_dir, failures: int = 2, window_ms: int = 86_400_000):
    """Breaker openings per session: the ``failures``-th error within one tumbling window opens it."""
    w = Window.partitionBy("session_id", "slot").orderBy("ms", "event_id")
    e = events(spark, sf_dir).filter("kind = 'error'").withColumn("slot", F.floor(F.col("ms") / window_ms))
    return e.withColumn("n", F.row_number().over(w)).filter(F.col("n") == failures).select("session_id", "slot", F.col("ms").alias("opened_ms"))


def seed_gate(terms: DataFrame, df: DataFrame, n: DataFrame, key: str, gate: float = 0.8, most: int = 5) -> DataFrame:
    """Of each key's terms, the ``most`` rarest with at least ``gate`` of its largest inverse document frequency."""
    idf = F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0))))
    scored = terms.join(df, "term", "left").join(F.broadcast(n)).select(key, "term", idf.alias("idf"))  # one row
    w = Window.partitionBy(key)
    kept = scored.withColumn("top", F.max("idf").over(w)).filter(F.col("idf") >= gate * F.col("top"))
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("idf"), "term"))).filter(F.col("rank") <= most).select(key, "rank", "term", "idf")


def k06(spark, sf_dir):
    """Seed terms of every passage by how rare they are among all documents."""
    terms = lambda c: F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), 0), lambda t: F.length(t) >= 3)))
    d = table(spark, sf_dir, "documents")
    df = d.select(terms(F.col("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", terms(F.col("text")).alias("term"))
    return seed_gate(asked, df, d.agg(F.count("*").alias("n")), "item_id").withColumn("idf", F.round("idf", 6))


ENTRIES = {
    "W01_lane_rank": Entry(w01, "select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents qualify rank<=20"),
    "W02_latest": Entry(w02, "with r as (select o_custkey id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) revision, round(o_totalprice,2) amount from orders) select * from r qualify row_number() over (partition by id order by revision desc)=1"),
    "W03_first_anchor": Entry(w03, "select source, lang, doc_id, n_chars from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id)=1"),
    "W05_idle_sessions": Entry(w05, "with a as (select user_id, event_id, (epoch_us(ts)//1000) ms, case when (epoch_us(ts)//1000)-lag((epoch_us(ts)//1000)) over w<=1800000 then 0 else 1 end nw from events window w as (partition by user_id order by (epoch_us(ts)//1000), event_id)), b as (select *, sum(nw) over (partition by user_id order by ms, event_id rows unbounded preceding) visit from a) select user_id session_id, cast(visit as bigint) visit, count(*) n, min(ms) first_ms, max(ms) last_ms from b group by 1,2"),
    "W06_keyset_page": Entry(w06, "select event_id, (epoch_us(ts)//1000) ms from events where (epoch_us(ts)//1000)<1706000000000 or ((epoch_us(ts)//1000)=1706000000000 and event_id>0) order by 2 desc, 1 limit 26"),
    "W07_alert_states": Entry(w07, "with recursive e as (select user_id session_id, event_id, case when event_type='error' then 'critical' when value>60 then 'warn' else 'ok' end as level, row_number() over (partition by user_id order by event_id) i from events), s as (select session_id, event_id, level, i, case when level='critical' then 'critical' else 'ok' end state, case when level='ok' then 0 else 1 end bad, case when level='ok' then 1 else 0 end good from e where i=1 union all select e.session_id, e.event_id, e.level, e.i, case when e.level='critical' then 'critical' when e.level='warn' and s.bad+1>=2 and s.state<>'critical' then 'warn' when e.level='ok' and s.good+1>=5 then 'ok' else s.state end, case when e.level='ok' then 0 else s.bad+1 end, case when e.level='ok' then s.good+1 else 0 end from s join e on e.session_id=s.session_id and e.i=s.i+1) select session_id, event_id, level, state from s"),
    "W08_breaker": Entry(w08, "with e as (select user_id session_id, event_id, (epoch_us(ts)//1000) ms, (epoch_us(ts)//1000)//86400000 slot from events where event_type='error') select session_id, slot, ms opened_ms from e qualify row_number() over (partition by session_id, slot order by ms, event_id)=2"),
    "W09_budget": Entry(w09, "with d as (select source, doc_id, octet_length(encode(text)) bytes from documents), c as (select *, sum(bytes) over (partition by source order by doc_id rows unbounded preceding) used from d) select source, doc_id, bytes, cast(used as bigint) used from c where used<=40000"),
    "K06_seed_gate": Entry(k06, "with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text),'[a-z0-9_]+')) term from documents), d as (select term, count(*) df from t group by 1), q as (select distinct item_id, unnest(regexp_extract_all(lower(text),'[a-z0-9_]+')) term from benchmark), i as (select item_id, q.term, ln(1+(select count(*) from documents)/(1+coalesce(df,0))) idf from q left join d on q.term=d.term where length(q.term)>=3), g as (select * from i qualify idf>=0.8*max(idf) over (partition by item_id)) select item_id, cast(row_number() over (partition by item_id order by g.idf desc, term) as integer) as rank, term, round(g.idf,6) idf from g qualify row_number() over (partition by item_id order by g.idf desc, term)<=5"),
}
