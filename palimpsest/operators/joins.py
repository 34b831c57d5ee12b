"""Joins of revisions, links, feedback and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.sources.shared import ROWS, cut, spread
from palimpsest.sources.tables import events, table


def revisions(spark, sf_dir) -> DataFrame:
    """Each customer's orders as the revisions 1, 2, ... of one record."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.row_number().over(w).alias("revision"), F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), F.round("o_totalprice", 2).alias("amount"))


def current(df: DataFrame) -> DataFrame:
    """The latest revision of each id."""
    return df.groupBy("id").agg(F.max("revision").alias("revision"))


def j01(spark, sf_dir):
    r = revisions(spark, sf_dir)
    return current(r).join(r, ["id", "revision"]).select("id", "revision", "source_id", "status")


def j02(spark, sf_dir):
    w = Window.partitionBy("id").orderBy("revision")
    r = revisions(spark, sf_dir).withColumn("before", F.lag("kind").over(w))
    return r.filter("before is not null and before <> kind").select("id", "revision", "before", "kind")


def j03(spark, sf_dir):
    """Order numbers whose predecessor within the order's lines is missing."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    prior = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"))
    return li.filter("l_linenumber > 1").join(prior, ["l_orderkey", "l_linenumber"], "left_anti")


def j04(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_nationkey")


def j07(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    both = li.join(parts, "l_partkey", "left_semi").join(suppliers, "l_suppkey", "left_semi")
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n"))


def j11(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").alias("f")
    d = table(spark, sf_dir, "orders").alias("d")
    ok = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("o_orderstatus") == "F")
    return f.join(d, ok).groupBy("l_linestatus").agg(F.count("*").alias("n"))


def j12(spark, sf_dir):
    r = revisions(spark, sf_dir)
    later = r.select("id", (F.col("revision") - 1).alias("revision"), F.col("source_id").alias("superseded_by"))
    return r.join(later, ["id", "revision"], "left").select("source_id", "superseded_by")


def j15(spark, sf_dir):
    r = revisions(spark, sf_dir)
    latest = current(r).join(r, ["id", "revision"]).select("id", F.col("status").alias("active"))
    return r.join(latest, "id").filter(~F.col("status").eqNullSafe(F.col("active"))).groupBy("status", "active").agg(F.count("*").alias("n"))


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str, end: str, width: int, differ: str | None = None) -> DataFrame:
    """Pairs (a.id > b.id) of one key whose [start, end) overlap; with ``differ``, whose values of that column differ.

    Of two that overlap one starts within the other: the bins of ``width`` that one covers meet the bin the other starts
    in, which is a single one, so that a pair is met once however many bins it shares. Where both sides are the same
    rows, a pair is met in one order only and turned afterwards.
    """
    named = lambda d, s: d.select(*[F.col(c).alias(f"{s}_{c}") for c in d.columns])
    at = lambda s, edge: F.floor((F.col(f"{s}_{edge}") - (1 if edge == end else 0)) / width)
    covers = lambda d, s: named(d, s).withColumn("bin", F.explode(F.sequence(at(s, start), F.greatest(at(s, start), at(s, end)))))
    starts = lambda d, s: named(d, s).withColumn("bin", at(s, start))
    a_start, b_start = F.col(f"a_{start}"), F.col(f"b_{start}")
    ids = F.col("a_id") != F.col("b_id") if a is b else F.col("a_id") > F.col("b_id")
    both = ids & (a_start < F.col(f"b_{end}")) & (b_start < F.col(f"a_{end}"))
    if differ is not None:
        both = both & (F.col(f"a_{differ}") != F.col(f"b_{differ}"))

    def met(x: DataFrame, y: DataFrame, order) -> DataFrame:
        # a join of few rows can yield many: it is dealt out by what it yields, into no more parts than there are bins
        n = lambda d, s: d.groupBy(F.col(f"{s}_{key}").alias("key"), "bin").agg(F.count("*").alias(f"{s}_n"))
        pairs, bins = n(x, "a").join(n(y, "b"), ["key", "bin"]).agg(F.sum(F.col("a_n") * F.col("b_n")), F.count("*")).first()
        x, y = (spread(d, min(pairs or 0, bins * ROWS), f"{s}_{key}", "bin") for d, s in ((x, "a"), (y, "b")))
        return x.join(y, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (x["bin"] == y["bin"]) & both & order).drop("bin")

    if a is b:
        first = met(covers(a, "a"), starts(b, "b"), (b_start > a_start) | ((b_start == a_start) & (F.col("b_id") > F.col("a_id"))))
        turned = F.col("a_id") < F.col("b_id")
        pick = lambda s, o, c: F.when(turned, F.col(f"{o}_{c}")).otherwise(F.col(f"{s}_{c}")).alias(f"{s}_{c}")
        return first.select(*[pick("a", "b", c) for c in a.columns], *[pick("b", "a", c) for c in a.columns])
    later = met(covers(a, "a"), starts(b, "b"), b_start >= a_start)
    return later.unionByName(met(starts(a, "a"), covers(b, "b"), a_start > b_start))


def j16(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("session_id", F.floor(F.col("ms") / 86400000).alias("day")).agg(F.min("ms").alias("start"), (F.max("ms") + 1).alias("end"), F.min_by("kind", "event_id").alias("kind"))
    s = cut(s.select((F.col("session_id") * 100000 + F.col("day")).alias("id"), F.pmod("session_id", F.lit(7)).alias("grp"), "start", "end", "kind"))
    return overlapping(s, s, "grp", "start", "end", 3600000, "kind").select("a_id", "b_id", "a_grp")


def j20(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    rolled = ev.filter("day < '2024-01-15'").groupBy("day").agg(F.count("*").alias("n"))
    detail = ev.filter("day >= '2024-01-15'").select("day", F.lit(1).cast("long").alias("n"))
    return rolled.unionByName(detail).groupBy("day").agg(F.sum("n").alias("n"))


def j21(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    claimed = d.groupBy("source").agg(F.count("*").alias("claimed"))
    seen = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("observed"))
    both = claimed.join(seen, "source", "full_outer").select("source", F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return both.filter("claimed <> observed")


def j23(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def j24(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").select("o_orderkey", "l_linenumber", "l_partkey")


def j26(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.max_by("event_id", F.struct("ms", "event_id")).alias("event_id"), F.max("ms").alias("ms"))


def j27(spark, sf_dir):
    ev = events(spark, sf_dir)
    up = ev.filter("k < 60").groupBy("session_id").agg(F.count("*").alias("upstream"))
    down = ev.filter("k >= 40").groupBy("session_id").agg(F.count("*").alias("downstream"))
    z = F.lit(0)
    return up.join(down, "session_id", "full_outer").select("session_id", F.coalesce("upstream", z).alias("upstream"), F.coalesce("downstream", z).alias("downstream"), (F.coalesce("upstream", z) - F.coalesce("downstream", z)).alias("gap"))


def j28(spark, sf_dir):
    """Pages that lie on or under one of some request paths."""
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    asked = F.broadcast(spark.createDataFrame([("en",), ("de/1",), ("fr",)], "path string"))  # a request's few paths
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("p"))
    return pages.join(asked, (F.col("p") == F.col("path")) | F.col("p").startswith(F.concat("path", F.lit("/"))), "left_semi").select("page_id", "p")


_REV = "with r as (select o_custkey id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) revision, o_orderkey source_id, o_orderstatus status, o_orderpriority kind from orders) "
ENTRIES = {
    "J01_current": Entry(j01, _REV + "select id, revision, source_id, status from r qualify revision = max(revision) over (partition by id)"),
    "J02_provenance": Entry(j02, _REV + "select * from (select id, revision, lag(kind) over (partition by id order by revision) as before, kind from r) where before<>kind"),
    "J03_gaps": Entry(j03, "with l as (select distinct l_orderkey, l_linenumber from lineitem) select * from l a where l_linenumber>1 and not exists (select 1 from l b where b.l_orderkey=a.l_orderkey and b.l_linenumber=a.l_linenumber-1)"),
    "J04_dangling": Entry(j04, "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority='1-URGENT')"),
    "J07_active_edges": Entry(j07, "select l_returnflag, count(*) n from lineitem where l_partkey in (select p_partkey from part where p_size>25) and l_suppkey in (select s_suppkey from supplier where s_acctbal>0) group by 1"),
    "J11_delivery": Entry(j11, "select l_linestatus, count(*) n from lineitem join orders on l_orderkey=o_orderkey and l_shipdate>=o_orderdate and o_orderstatus='F' group by 1"),
    "J12_superseded_by": Entry(j12, _REV + "select a.source_id, b.source_id superseded_by from r a left join r b on a.id=b.id and b.revision=a.revision+1"),
    "J15_versions": Entry(j15, _REV + ", l as (select id, status active from r qualify revision = max(revision) over (partition by id)) select status, active, count(*) n from r join l using(id) where status is distinct from active group by 1,2"),
    "J16_overlap": Entry(j16, "with s as (select user_id*100000+(epoch_us(ts)//1000)//86400000 id, user_id%7 grp, min((epoch_us(ts)//1000)) s, max((epoch_us(ts)//1000))+1 e, arg_min(event_type,event_id) kind from events group by user_id, (epoch_us(ts)//1000)//86400000) select a.id a_id, b.id b_id, a.grp a_grp from s a join s b on a.grp=b.grp and a.id>b.id and a.s<b.e and b.s<a.e and a.kind<>b.kind"),
    "J20_union_read": Entry(j20, "select strftime(ts,'%Y-%m-%d') as day, count(*) n from events group by 1"),
    "J21_drift": Entry(j21, "select source, count(*) claimed, count(l.doc_id) observed from documents d left join (select distinct doc_id from labels) l using(doc_id) group by 1 having count(*)<>count(l.doc_id)"),
    "J23_path": Entry(j23, "select n_name, count(*) n, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) cents from customer join nation on c_nationkey=n_nationkey join orders on o_custkey=c_custkey group by 1"),
    "J24_optional": Entry(j24, "select o_orderkey, l_linenumber, l_partkey from orders left join lineitem on o_orderkey=l_orderkey and l_quantity>49"),
    "J26_checkpoint": Entry(j26, "select event_type kind, arg_max(event_id,((epoch_us(ts)//1000),event_id)) event_id, max((epoch_us(ts)//1000)) ms from events group by 1"),
    "J27_divergence": Entry(j27, "with e as (select user_id, cast(json_extract_string(props,'$.k') as int) k from events) select user_id session_id, count(*) filter (k<60) upstream, count(*) filter (k>=40) downstream, count(*) filter (k<60)-count(*) filter (k>=40) gap from e where k<60 or k>=40 group by 1"),
    "J28_applicability": Entry(j28, "with p as (select page_id, regexp_extract(url,'^https?://[^/]+/([^?#]*)',1) p from pages) select * from p where p in ('en','de/1','fr') or p like 'en/%' or p like 'de/1/%' or p like 'fr/%'"),
}
