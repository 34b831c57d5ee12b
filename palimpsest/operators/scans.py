"""Point and filtered scans, routing predicates, and the lookups that enrich what they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.operators.graph import links
from palimpsest.operators.joins import revisions
from palimpsest.operators.predicates import conjunction
from palimpsest.operators.temporal import facts, temporal_multiplier, temporal_state
from palimpsest.sources.shared import remove, shared_folder
from palimpsest.sources.tables import transcript_lines, events, table


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the comparison reaches the files' statistics."""
    return df.filter(F.col(key) == value)


def latest_unsuppressed(df: DataFrame, key: str, order: list[str], suppressed: DataFrame, newest: Column, n: int) -> DataFrame:
    """The latest row of each key that is not suppressed, newest first, at most ``n``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(suppressed, key, "left_anti").orderBy(newest, key).limit(n)


def s01(spark, sf_dir):
    return events(spark, sf_dir).filter((F.col("value") > 50) & (F.col("kind") == "purchase")).select("event_id", "value")


def s02(spark, sf_dir):
    return by_key(events(spark, sf_dir), "session_id", 7).select("event_id", "kind", "ms")


def s03(spark, sf_dir):
    return events(spark, sf_dir).select("session_id").distinct()


def s04(spark, sf_dir):
    return by_key(events(spark, sf_dir), "event_id", 123).orderBy("ms").limit(1).select("event_id", "kind", "ms")


def s06(spark, sf_dir):
    r = revisions(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return latest_unsuppressed(r, "id", ["revision"], gone, F.desc("revision"), 2000).select("id", "revision", "source_id")


def s10(spark, sf_dir):
    """Events as hits: a text by kind, a symbol, a severity."""
    text = F.when(F.col("kind") == "purchase", F.format_string("bought %d", "k")).when(F.col("kind") == "error", F.format_string("failed %d", "k")).otherwise(F.col("kind"))
    return events(spark, sf_dir).select("event_id", text.alias("text"), F.concat(F.lit("s/"), F.col("session_id")).alias("symbol"), F.when(F.col("kind") == "error", "critical").alias("severity"))


def s18(spark, sf_dir):
    """Answers paired with the question before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"), F.lag("role").over(w).alias("before"), F.lag("turn").over(w).alias("asked"))
    return c.filter("role = 'assistant' and before = 'user'").select("conv_id", "turn", "asked", "size")


def s29(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderkey > 1000").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("next"))


def s30(spark, sf_dir):
    """Counters in exposition format."""
    n = events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return n.select(F.format_string('events_total{kind="%s"} %d', "kind", "n").alias("line"))


def f02(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ok = conjunction([F.col("p_size") > 10, ~F.col("p_type").isin("PROMO", "SMALL"), F.coalesce(F.col("p_retailprice"), F.lit(0.0)) < 1500])
    return p.filter(ok).select("p_partkey")


def f03(spark, sf_dir):
    return revisions(spark, sf_dir).filter(~F.col("status").isin("F")).groupBy("status").agg(F.count("*").alias("n"))


def f05(spark, sf_dir):
    """Hits since a time, on some topics, under some prefixes; rows without the attribute pass."""
    ev = events(spark, sf_dir).withColumn("topic", F.when(F.col("k") % 10 > 0, F.col("kind")))
    return ev.filter(((F.col("ms") == 0) | (F.col("ms") >= 1705000000000)) & (F.col("topic").isNull() | F.col("topic").isin("error", "signup"))).groupBy("kind").agg(F.count("*").alias("n"))


def f07(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '3-MEDIUM') and o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01'")
    return o.select("o_orderkey", "o_orderpriority")


# The index that holds each kind.
ROUTES = {"click": "turns", "view": "turns", "error": "violations", "purchase": "decisions", "signup": "memories"}


def events_by_kind(ev: DataFrame, kind: str, session: int | None = None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """(index, event_id, ..): events of one kind, with the index they are in; conditions that are not asked for drop nothing."""
    if kind not in ROUTES:
        raise ValueError(f"unknown kind {kind}")
    asked = [F.col("kind") == kind]
    asked += [] if session is None else [F.col("session_id") == session]
    asked += [] if since_ms is None else [F.col("ms") >= since_ms]
    asked += [] if until_ms is None else [F.col("ms") < until_ms]
    for c in asked:
        ev = ev.filter(c)
    return ev.withColumn("index", F.lit(ROUTES[kind]))


def f09(spark, sf_dir):
    """What four requests find: one of each condition, and one of all."""
    ev = events(spark, sf_dir)
    day = 86_400_000
    asked = [("error", {}), ("click", {"session": 3}), ("purchase", {"since_ms": 1_704_067_200_000 + 9 * day}), ("view", {"session": 5, "since_ms": 1_704_067_200_000 + 2 * day, "until_ms": 1_704_067_200_000 + 20 * day})]
    found = [events_by_kind(ev, kind, **more).select(F.lit(n).alias("request"), "index", "event_id") for n, (kind, more) in enumerate(asked)]
    return reduce(DataFrame.unionByName, found)


def f10(spark, sf_dir):
    asked = F.rtrim(F.lit("red:"), F.lit(":"))
    return table(spark, sf_dir, "part").filter(F.startswith("p_name", asked)).select("p_partkey", "p_name")


def f13(spark, sf_dir):
    return events(spark, sf_dir).filter("ms >= 1706600000000").select("event_id", "ms")


def f17(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("c", F.array("lang", "source"))
    return d.filter(F.exists("c", lambda c: c.isin("en", "src3", "src7"))).groupBy("lang").agg(F.count("*").alias("n"))


def f19(spark, sf_dir):
    """Parts whose branch is in a branch's ancestry."""
    line = spark.createDataFrame([(b,) for b in ("Brand#1", "Brand#3")], "p_brand string")
    return table(spark, sf_dir, "part").join(F.broadcast(line), "p_brand", "left_semi").select("p_partkey", "p_brand")  # one ancestry


def f23(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    family = F.when(F.col("n_chars") > 4000, "code").when(F.col("lang") == "en", "docs").otherwise("misc")
    return d.groupBy(F.concat_ws("-", F.lower("source"), family).alias("collection")).agg(F.count("*").alias("n"))


def f24(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


def f28(spark, sf_dir):
    """Links that survive extraction: both ends known, and how many of each source were refused."""
    known = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("dst"))
    e = links(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    marked = e.join(known.withColumn("ok", F.lit(1)), "dst", "left")
    return marked.groupBy("src").agg(F.count("ok").alias("kept"), (F.count("*") - F.count("ok")).alias("refused"))


def j05(spark, sf_dir):
    """Rows without an archive entry under the key that their kind uses."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("key"))
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("key"))
    return o.join(seen, "key", "left_anti").select("o_orderkey")


def j06(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return revisions(spark, sf_dir).join(gone, "id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


def j08(spark, sf_dir):
    """Two lanes merged on their document, the first lane's row standing for it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("lane"), F.col("n_chars").cast("double").alias("score"))
    x = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("lane"), (F.col("quality") * 100.0).alias("score"))
    return d.unionByName(x).groupBy("doc_id").agg(F.sum("score").alias("score"), F.min("lane").alias("lane"), F.count("*").alias("lanes"))


def j10(spark, sf_dir):
    top = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")
    return table(spark, sf_dir, "labels").join(top, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


def j14(spark, sf_dir):
    """Ordered pairs of decisions of one record, the later of which says that it supersedes the earlier.

    Final orders name the decision they supersede, up to three revisions back; some name one that came after them, and
    that is no supersession.
    """
    r = revisions(spark, sf_dir)
    named = F.when(F.col("source_id") % 7 == 0, F.col("revision") + 1).otherwise(F.col("revision") - 1 - F.col("source_id") % 3)
    ids = r.select("id", F.col("revision").alias("named"), F.col("source_id").alias("supersedes"))
    said = r.filter("status = 'F'").withColumn("named", named).join(ids, ["id", "named"]).select(F.col("source_id").alias("later"), F.col("revision").alias("at"), "supersedes")
    earlier = r.select(F.col("source_id").alias("supersedes"), F.col("revision").alias("before"))
    return said.join(earlier, "supersedes").filter("at > before").select("later", F.col("supersedes").alias("earlier"))


def j22(spark, sf_dir):
    """Facts of asked subjects that hold at the time, rescored and ordered."""
    asked = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("subject"))
    state = temporal_state(F.lit("1998-06-01").cast("date"))
    f = facts(spark, sf_dir).join(asked, "subject", "left_semi").withColumn("score", F.round(F.col("score") * temporal_multiplier(state), 6))
    return f.filter("score is not null").orderBy(F.desc("score"), "id").limit(100).select("id", "subject", "score")


def j25(spark, sf_dir):
    """Ids of a document in each table that knows it."""
    d, x, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings")
    j = d.select("doc_id").join(x.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").join(e.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded")), "doc_id", "left")
    no = F.lit(False)
    return j.select("doc_id", F.coalesce("labelled", no).alias("labelled"), F.coalesce("embedded", no).alias("embedded"))


def a15(spark, sf_dir):
    """Members of each kind's cluster: span, outcomes as counts, the first name."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    entry = F.concat_ws(":", "o_orderstatus", F.col("n").cast("string"))
    return c.groupBy("o_custkey").agg(F.date_format(F.min("a"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("z"), "yyyy-MM-dd").alias("last"), F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("outcomes"))


def a27(spark, sf_dir):
    state = temporal_state(F.lit("1998-06-01").cast("date"))
    action = F.when(temporal_multiplier(state).isNull(), "drop").when(state == "temporal", "boost").otherwise("keep")
    return facts(spark, sf_dir).groupBy(state.alias("state"), action.alias("action")).agg(F.count("*").alias("n"))


def a31(spark, sf_dir):
    """Share of a source's documents that each other table knows."""
    j = j25(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return j.groupBy("source").agg(F.count("*").alias("n"), share("labelled"), share("embedded"))


def a42(spark, sf_dir):
    ev = events(spark, sf_dir)
    external = F.count_if(F.col("k") >= 50) / F.count("*")
    return ev.groupBy("kind").agg(F.round(external, 6).alias("external"), F.count("*").alias("n")).withColumn("passed", F.col("external") >= 0.45)


def x07(spark, sf_dir):
    """One row of each law reference, the first by its place."""
    e = links(spark, sf_dir)
    return e.groupBy("type", "dst").agg(F.min("src").alias("src"))


def k02(spark, sf_dir, n: int = 100):
    p = table(spark, sf_dir, "part")
    score = F.when(F.contains("p_name", F.lit("ring")), 2.0).when(F.contains("p_name", F.lit("red")), 1.0)
    return p.withColumn("score", score).filter("score is not null").orderBy(F.desc("score"), F.desc("p_size"), "p_partkey").limit(n).select("p_partkey", "score")


def k08(spark, sf_dir, asked: int = 5000):
    """A page whose asked limit is clamped to 1..200."""
    return events(spark, sf_dir).orderBy("ms", "event_id").limit(min(max(asked, 1), 200)).select("event_id")


def _transcripts(spark, sf_dir) -> str:
    """A folder of transcripts: a line a turn, some of them broken, some without a type, and files of other names."""
    import atexit
    import uuid

    base = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    n = F.col("conv_id") * 100 + F.col("turn")
    line = F.to_json(F.struct(F.when(n % 13 != 0, F.col("role")).alias("type"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("message")))
    rows = table(spark, sf_dir, "conversations").select(F.when(n % 11 == 0, F.substring(line, 1, 15)).otherwise(line).alias("value"), (F.col("conv_id") % 4).alias("project"))
    rows.write.partitionBy("project").option("compression", "none").text(f"{base}/projects")
    rows.select("value").write.option("compression", "gzip").text(f"{base}/projects/old")
    return base


def s16(spark, sf_dir):
    """How many lines of each project's transcripts are read, corrupt or unknown."""
    lines = transcript_lines(spark, f"{_transcripts(spark, sf_dir)}/projects", "*.txt")
    return lines.groupBy(F.regexp_extract("file", "project=([0-9]+)", 1).cast("int").alias("project"), "state").agg(F.count("*").alias("n"))


def s17(spark, sf_dir):
    """Files of a transcript folder by what their names say, beside all of them: sessions read by either."""
    path = f"{_transcripts(spark, sf_dir)}/projects"
    some = [(name, transcript_lines(spark, path, include)) for name, include in (("plain", "*.txt"), ("packed", "*.gz"), ("all", "part-*"))]
    each = [df.filter("state = 'read'").select(F.lit(name).alias("include"), "session_id") for name, df in some]
    return reduce(DataFrame.unionByName, each).groupBy("include").agg(F.count("*").alias("lines"), F.countDistinct("session_id").alias("sessions"))


_R = "with r as (select o_custkey id, row_number() over w revision, o_orderkey source_id, o_orderstatus status from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) "
_F = "with f as (select o_orderkey id, o_custkey subject, cast(o_orderdate as date) valid_from, case when o_orderstatus='F' then cast(o_orderdate as date)+120 end valid_to, lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) superseded_at, case when o_orderpriority='5-LOW' then 'abandoned' else 'active' end lifecycle, round(o_totalprice/1000,3) score from orders), s as (select *, case when superseded_at<=date '1998-06-01' then 'superseded' when valid_to<=date '1998-06-01' then 'expired' when valid_from>date '1998-06-01' then 'not_yet_valid' when lifecycle='abandoned' then 'abandoned' when valid_to<=date '1998-07-01' then 'temporal' else 'valid' end state from f) "
_L = "with li as (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) dst, case l_returnflag when 'R' then 'CALLS' when 'A' then 'CITES' else 'IMPORTS' end as type from lineitem), e as (select * from li where dst is not null and src<>dst) "
_K = "cast(json_extract_string(props,'$.k') as int)"
_TURNS = "with n as (select conv_id, conv_id*100+turn n from conversations), t as (select conv_id, case when n%11=0 then 'corrupt' when n%13=0 then 'unknown' else 'read' end state from n) "
ENTRIES = {
    "S16_transcripts": Entry(s16, _TURNS + "select cast(conv_id%4 as int) project, state, count(*) n from t group by 1,2"),
    "S17_included": Entry(s17, _TURNS + "select include, count(*)*any_value(k) as lines, count(distinct conv_id) sessions from t, (values ('plain',1),('packed',1),('all',2)) i(include,k) where state='read' group by include"),
    "S01_scan": Entry(s01, "select event_id, value from events where value>50 and event_type='purchase'"),
    "S02_session": Entry(s02, "select event_id, event_type kind, epoch_us(ts)//1000 ms from events where user_id=7"),
    "S03_sessions": Entry(s03, "select distinct user_id session_id from events"),
    "S04_point": Entry(s04, "select event_id, event_type kind, epoch_us(ts)//1000 ms from events where event_id=123 order by ms limit 1"),
    "S06_snapshot": Entry(s06, _R + "select id, revision, source_id from r where id not in (select c_custkey from customer where c_acctbal<0) qualify revision=max(revision) over (partition by id) order by revision desc, id limit 2000"),
    "S10_hits": Entry(s10, f"select event_id, case event_type when 'purchase' then 'bought ' || {_K} when 'error' then 'failed ' || {_K} else event_type end as text, 's/' || user_id symbol, case when event_type='error' then 'critical' end severity from events"),
    "S18_pairs": Entry(s18, "with c as (select conv_id, turn, role, length(text) size, lag(role) over w b, lag(turn) over w asked from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, asked, size from c where role='assistant' and b='user'"),
    "S29_rowid_tail": Entry(s29, "select count(*) n, max(o_orderkey) as next from orders where o_orderkey>1000"),
    "S30_exposition": Entry(s30, "select 'events_total{kind=\"' || event_type || '\"} ' || count(*) line from events group by event_type"),
    "F02_eligible": Entry(f02, "select p_partkey from part where p_size>10 and p_type not in ('PROMO','SMALL') and coalesce(p_retailprice,0)<1500"),
    "F03_active": Entry(f03, "select o_orderstatus status, count(*) n from orders where o_orderstatus<>'F' group by 1"),
    "F05_scope_hits": Entry(f05, f"with e as (select event_type, epoch_us(ts)//1000 ms, case when {_K}%10>0 then event_type end t from events) select event_type kind, count(*) n from e where ms>=1705000000000 and (t is null or t in ('error','signup')) group by 1"),
    "F07_decisions": Entry(f07, "select o_orderkey, o_orderpriority from orders where o_orderstatus='F' and o_orderpriority in ('1-URGENT','3-MEDIUM') and o_orderdate>='1996-01-01' and o_orderdate<'1998-01-01'"),
    "F09_routes": Entry(f09, "with e as (select event_id, event_type k, user_id s, epoch_us(ts)//1000-1704067200000 d from events) select 0 as request, 'violations' as index, event_id from e where k='error' union all select 1, 'turns', event_id from e where k='click' and s=3 union all select 2, 'decisions', event_id from e where k='purchase' and d>=9*86400000 union all select 3, 'turns', event_id from e where k='view' and s=5 and d>=2*86400000 and d<20*86400000"),
    "F10_cards": Entry(f10, "select p_partkey, p_name from part where starts_with(p_name,'red')"),
    "F13_since": Entry(f13, "select event_id, epoch_us(ts)//1000 ms from events where epoch_us(ts)//1000>=1706600000000"),
    "F17_any_grant": Entry(f17, "select lang, count(*) n from documents where lang in ('en','src3','src7') or source in ('en','src3','src7') group by 1"),
    "F19_branches": Entry(f19, "select p_partkey, p_brand from part where p_brand in ('Brand#1','Brand#3')"),
    "F23_collections": Entry(f23, "select lower(source) || '-' || case when n_chars>4000 then 'code' when lang='en' then 'docs' else 'misc' end collection, count(*) n from documents group by 1"),
    "F24_turns": Entry(f24, "select role, count(*) n, count(distinct conv_id) conversations from conversations where role<>'system' group by 1"),
    "F28_extraction": Entry(f28, _L + ", g as (select distinct src, dst from e) select src, count(p_partkey) kept, count(*)-count(p_partkey) refused from g left join (select p_partkey from part where p_size>5) on p_partkey=dst group by 1"),
    "J05_unarchived": Entry(j05, "select o_orderkey from orders where (case when o_orderstatus='F' then o_orderkey else o_custkey end) not in (select l_orderkey from lineitem where l_returnflag='A')"),
    "J06_unsuppressed": Entry(j06, "select o_orderstatus status, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment='BUILDING') group by 1"),
    "J08_merged_lanes": Entry(j08, "with u as (select doc_id, 0 lane, n_chars::double score from documents union all select doc_id, 1, quality*100.0::double from labels) select doc_id, sum(score)::double score, min(lane) lane, count(*) lanes from u group by 1"),
    "J10_candidates": Entry(j10, "select doc_id, quality, toxic from labels where doc_id in (select doc_id from documents order by n_chars desc, doc_id limit 100)"),
    "J14_superseding": Entry(j14, _R + "select a.source_id later, b.source_id earlier from r a join r b on a.id=b.id and a.revision>b.revision and b.revision=case when a.source_id%7=0 then a.revision+1 else a.revision-1-a.source_id%3 end where a.status='F'"),
    "J22_propagated": Entry(j22, _F + "select id, subject, round(score*case when state='temporal' then 1.1 else 1.0 end,6) score from s where state in ('temporal','valid') and subject in (select c_custkey from customer where c_mktsegment='MACHINERY') order by 3 desc, 1 limit 100"),
    "J25_identities": Entry(j25, "select doc_id, doc_id in (select doc_id from labels) labelled, doc_id in (select vec_id from embeddings) embedded from documents"),
    "A15_members": Entry(a15, "with c as (select o_custkey, o_orderstatus, count(*) n, min(o_orderdate) a, max(o_orderdate) z from orders group by 1,2) select o_custkey, strftime(min(a),'%Y-%m-%d') as first, strftime(max(z),'%Y-%m-%d') as last, string_agg(o_orderstatus || ':' || n, ',' order by o_orderstatus || ':' || n) outcomes from c group by 1"),
    "A27_states": Entry(a27, _F + "select state, case when state='temporal' then 'boost' when state='valid' then 'keep' else 'drop' end as action, count(*) n from s group by 1,2"),
    "A31_coverage": Entry(a31, "select source, count(*) n, round(avg(case when doc_id in (select doc_id from labels) then 1 else 0 end),6) labelled, round(avg(case when doc_id in (select vec_id from embeddings) then 1 else 0 end),6) embedded from documents group by 1"),
    "A42_shape_audit": Entry(a42, f"select event_type kind, round(count(*) filter ({_K}>=50)/count(*),6) as external, count(*) n, round(count(*) filter ({_K}>=50)/count(*),6)>=0.45 passed from events group by 1"),
    "X07_references": Entry(x07, _L + "select type, dst, min(src) src from e group by 1,2"),
    "K02_title_order": Entry(k02, "with p as (select p_partkey, p_size, case when contains(p_name,'ring') then 2.0 when contains(p_name,'red') then 1.0 end::double score from part) select p_partkey, score from p where score is not null order by score desc, p_size desc, p_partkey limit 100"),
    "K08_clamped": Entry(k08, "select event_id from events order by epoch_us(ts)//1000, event_id limit 200"),
}
