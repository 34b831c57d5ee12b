"""Set operations over keys and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.sources.tables import events, table


def x01(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.filter("lang = 'en'").select("source", "n_chars").distinct()
    b = d.filter("lang = 'de'").select("source", "n_chars").distinct()
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "expected_only")).unionByName(n(b.subtract(a), "live_only"))


def x02(spark, sf_dir):
    slugs = table(spark, sf_dir, "documents").select("source").distinct()
    families = F.array(*[F.lit(x) for x in ("code", "docs", "turns", "misc")])
    return slugs.select(F.explode(F.transform(families, lambda x: F.concat_ws("-", "source", x))).alias("collection"))


def x03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = lambda n: o.filter(F.col("c_nationkey") == n).select("o_orderpriority", "o_orderstatus").distinct()
    a, b = side(1), side(2)
    return a.intersect(b).select(F.lit("shared").alias("side"), "*").unionByName(a.subtract(b).select(F.lit("left").alias("side"), "*")).unionByName(b.subtract(a).select(F.lit("right").alias("side"), "*"))


def x04(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.max(F.col("quality") + 2 * F.col("toxic")).alias("level"), F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("compartments"))


def x05(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    lanes = c.select(F.lit("customer").alias("lane"), F.col("c_nationkey").alias("nation")).unionByName(s.select(F.lit("supplier").alias("lane"), F.col("s_nationkey").alias("nation")))
    return lanes.groupBy("lane", "nation").agg(F.count("*").alias("n"))


def x06(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.lit("SUPPLIED_BY").alias("type"), "l_partkey", "l_suppkey").dropDuplicates()


def x08(spark, sf_dir):
    ev = events(spark, sf_dir).groupBy("session_id").agg(F.collect_set("kind").alias("a"), F.collect_set(F.when(F.col("k") < 15, F.col("kind"))).alias("b"))
    return ev.select("session_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def set_recall(observed: Column, expected: Column) -> Column:
    """The share of ``expected`` that was observed; nothing expected is all found."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(observed, expected)) / F.size(expected))


def x09(spark, sf_dir):
    """Of the payload keys of each session's purchases, those that its clicks had too."""
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("k")))  # noqa: E731  keys are below a hundred
    ev = events(spark, sf_dir).groupBy("session_id").agg(of("click").alias("seen"), of("purchase").alias("want"))
    return ev.select("session_id", F.round(set_recall(F.col("seen"), F.col("want")), 6).alias("recall"))


ENTRIES = {
    "X01_coverage": Entry(x01, "with a as (select distinct source, n_chars from documents where lang='en'), b as (select distinct source, n_chars from documents where lang='de') select 'both' part, count(*) n from (from a intersect from b) union all select 'expected_only', count(*) from (from a except from b) union all select 'live_only', count(*) from (from b except from a)"),
    "X02_expected": Entry(x02, "select source || '-' || f collection from (select distinct source from documents), (select unnest(['code','docs','turns','misc']) f)"),
    "X03_neighbourhoods": Entry(x03, "with o as (select distinct c_nationkey n, o_orderpriority, o_orderstatus from orders join customer on o_custkey=c_custkey), a as (select o_orderpriority, o_orderstatus from o where n=1), b as (select o_orderpriority, o_orderstatus from o where n=2) select 'shared' side, * from (from a intersect from b) union all select 'left', * from (from a except from b) union all select 'right', * from (from b except from a)"),
    "X04_sensitivity": Entry(x04, "select source, max(quality+2*toxic) as level, string_agg(distinct lang, ',' order by lang) compartments from documents join labels using(doc_id) group by 1"),
    "X05_lanes": Entry(x05, "select 'customer' lane, c_nationkey nation, count(*) n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2"),
    "X06_edges": Entry(x06, "select distinct 'SUPPLIED_BY' as type, l_partkey, l_suppkey from lineitem"),
    "X08_jaccard": Entry(x08, "with e as (select user_id, event_type, cast(json_extract_string(props,'$.k') as int) k from events) select user_id session_id, round(count(distinct case when k<15 then event_type end)/count(distinct event_type),6) jaccard from e group by 1"),
    "X09_recall": Entry(x09, "with e as (select distinct user_id, event_type, json_extract_string(props,'$.k') k from events), w as (select distinct user_id, k from e where event_type='purchase' and k is not null), s as (select distinct user_id, k from e where event_type='click') select u.user_id session_id, coalesce(round(count(s.k)/nullif(count(w.k),0),6),1.0) recall from (select distinct user_id from events) u left join w using(user_id) left join s on s.user_id=w.user_id and s.k=w.k group by 1"),
}
