"""What the serving side asks of the records: filters from optional conditions, summaries, labels and evidence joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.catalog import Entry
from palimpsest.operators.joins import revisions
from palimpsest.operators.retention import age_days, demotion
from palimpsest.operators.retrieval import r03
from palimpsest.sources.shared import shared_folder
from palimpsest.sources.tables import AS_OF, events, scan_events, table, write_events


def conditions(since: tuple[str, object] | None = None, until: tuple[str, object] | None = None, **equal: object) -> Column:
    """All that is given has to hold: a column equals its value or is one of a list; no condition keeps every row."""
    kept = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            kept = kept & (F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    if since is not None:
        kept = kept & (F.col(since[0]) >= since[1])
    return kept if until is None else kept & (F.col(until[0]) < until[1])


def consolidations(spark, sf_dir) -> DataFrame:
    """Orders as consolidations: grain, repository, text and time."""
    o = table(spark, sf_dir, "orders")
    grain = F.when(F.col("o_orderstatus") == "F", "session").when(F.col("o_orderstatus") == "O", "topic").otherwise("decision_trace")
    return o.select(F.col("o_orderkey").alias("id"), grain.alias("grain"), F.expr("o_custkey div 100").alias("repo"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def f01(spark, sf_dir):
    """The read model: what holds of each record now, and its links to others."""
    now = revisions(spark, sf_dir).groupBy("id").agg(F.max_by(F.struct("revision", "source_id", "status", "amount"), "revision").alias("r")).select("id", "r.*")
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.countDistinct("l_partkey").alias("links"))
    return now.join(links, "source_id", "left").select("id", "revision", "status", "amount", F.coalesce("links", F.lit(0)).alias("links"))


def f08(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("law"), F.col("l_linestatus").alias("severity"), F.col("l_shipdate").cast("date").alias("day"))
    return v.filter(conditions(law="R", severity=["F", "O"], since=("day", "1995-01-01"), until=("day", "1996-01-01"))).drop("day")


def f11(spark, sf_dir):
    return consolidations(spark, sf_dir).filter(conditions(grain=["session", "topic"], repo=0, since=("day", "1996-01-01"))).select("id", "grain")


def f12(spark, sf_dir):
    return consolidations(spark, sf_dir).filter(conditions(title="2-HIGH", grain="topic")).select("id", "repo")


def by_entity(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Repositories and grains are filters that decide; every other entity is a word to look for."""
    return df.filter(F.col(kind).cast("string") == value if kind in ("repo", "grain") else F.contains(F.lower("title"), F.lit(value.lower())))


def f14(spark, sf_dir):
    c = consolidations(spark, sf_dir)
    asked = [("repo", "4"), ("grain", "decision_trace"), ("function", "urgent"), ("file", "Low")]
    found = [by_entity(c, k, v).agg(F.count("*").alias("n"), F.max("id").alias("last_id")).select(F.lit(k).alias("entity"), F.lit(v).alias("value"), "n", "last_id") for k, v in asked]
    return found[0].union(found[1]).union(found[2]).union(found[3])


def triggered(tool: Column, action: Column, args: Column, law: dict) -> Column:
    """A law's trigger: its tool and action whatever their case, its pattern somewhere in the arguments; what it leaves out
    always holds."""
    hit = F.lit(True)
    for c, want in ((tool, law.get("tool")), (action, law.get("action"))):
        if want is not None:
            hit = hit & F.coalesce(F.lower(c) == want.lower(), F.lit(False))
    return hit & F.coalesce(args.rlike(law["args"]), F.lit(False)) if law.get("args") else hit


TRIGGERS = {"all": {}, "tool": {"tool": "CLICK"}, "both": {"tool": "error", "action": "Error"}, "args": {"action": "success", "args": "[13579]$"}}


def f26(spark, sf_dir):
    ev = events(spark, sf_dir)
    hits = [F.count_if(triggered(F.col("kind"), F.col("outcome"), F.col("k").cast("string"), law)).alias(name) for name, law in TRIGGERS.items()]
    return ev.groupBy("session_id").agg(*hits)


def f31(spark, sf_dir):
    """Marker rows leave the hits and become notes of their lane; here, documents without a language or text."""
    d = table(spark, sf_dir, "documents")
    marker = F.col("lang").isNull() | (F.coalesce(F.length("text"), F.lit(0)) < 40)
    return d.groupBy(F.col("source").alias("lane")).agg(F.count_if(~marker).alias("hits"), F.count_if(marker).alias("notes"))


def cap_strings(c: Column, kind: T.DataType, most: int) -> Column:
    """A nested value with every text in it cut to ``most`` characters, whatever holds it."""
    if isinstance(kind, T.StringType):
        return F.left(c, F.lit(most))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: cap_strings(x, kind.elementType, most))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: cap_strings(x, kind.valueType, most))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[cap_strings(c[f.name], f.dataType, most).alias(f.name) for f in kind]))
    return c


def f33(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nested = d.select("doc_id", F.struct("lang", "n_chars", F.array("text", F.struct("text")["text"]).alias("texts"), F.create_map(F.lit("source"), F.col("source")).alias("at")).alias("v"))
    capped = nested.select("doc_id", cap_strings(F.col("v"), nested.schema["v"].dataType, 20).alias("v"))
    return capped.select("doc_id", "v.lang", "v.n_chars", F.element_at("v.texts", 2).alias("text"), F.col("v.at")["source"].alias("source"))


def a26(spark, sf_dir):
    """Of each lane: hits, and those that fall for each reason."""
    d, n = table(spark, sf_dir, "documents"), F.coalesce(F.length(F.trim(F.col("text"))), F.lit(0))
    drop = F.when(n == 0, "empty").when(n < 200, "short").when(F.col("lang").isNull(), "scope")
    return d.withColumn("drop", drop).groupBy(F.col("source").alias("lane")).agg(F.count("*").alias("hits"), *[F.count_if(F.col("drop") == r).alias(r) for r in ("empty", "short", "scope")], F.count_if(F.col("drop").isNull()).alias("kept"))


def a28(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("phase"))
    return o.groupingSets([["status"], ["phase"], []], "status", "phase").agg(F.count("*").alias("n"))


def a32(spark, sf_dir):
    """Received and archived of each hour, what lies between and how that grew since the hour before."""
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
    per = events(spark, sf_dir).groupBy(hour).agg(F.count("*").alias("received"), F.count_if(F.col("outcome") == "success").alias("archived"))
    gap = per.withColumn("delta", F.col("received") - F.col("archived"))
    return gap.withColumn("growth", F.col("delta") - F.coalesce(F.lag("delta").over(Window.orderBy("hour")), F.lit(0)))  # one row an hour


def a35(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("sections"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


def floor_top(df: DataFrame, key: str, score: str, tie: str, k: int, floor: float = 0.6) -> DataFrame:
    """The best ``k`` (1 to 10) of each key with at least the floor."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.filter(F.col(score) >= floor).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, min(10, k)))


def k05(spark, sf_dir):
    ev = events(spark, sf_dir).select("session_id", "event_id", (F.col("value") / 100).alias("score"))
    return floor_top(ev, "session_id", "score", "event_id", 25).select("session_id", "event_id", "rank")


def k10(spark, sf_dir, n: int = 30):
    return consolidations(spark, sf_dir).orderBy(F.desc("day"), "id").limit(n).select("id", "grain", F.col("day").cast("string").alias("day"))


def r22(spark, sf_dir):
    """Sessions like those asked for: neighbours of each asked vector above a floor, here 0.4, as the table's vectors lie apart."""
    near = r03(spark, sf_dir).select("q", "doc_id", "score")
    return floor_top(near, "q", "score", "doc_id", 3, floor=0.4).select("q", "doc_id", "rank", "score")


def w04(spark, sf_dir, n: int = 8):
    """Ranks start anew after the filter."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en' and n_chars < 2000")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return d.select("source", "doc_id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)


def ago(seconds: Column) -> Column:
    """A label of an age: now, minutes, hours, days."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit + " ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def w11(spark, sf_dir):
    """How long ago each session was seen last, counted from the last event of all."""
    last = events(spark, sf_dir).groupBy("session_id").agg(F.max("ms").alias("ms"))
    end = last.agg(F.max("ms").alias("end"))
    return last.join(F.broadcast(end)).select("session_id", ago(F.expr("(end - ms) div 1000")).alias("seen"))  # one row


def hits(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.lit(1).alias("revision"), F.md5("text").alias("content_hash"), F.md5("source").alias("source_hash"))


def j09(spark, sf_dir):
    """Feedback counts for a hit if it was given on the very revision and content."""
    judged = table(spark, sf_dir, "labels").join(hits(spark, sf_dir), "doc_id")
    given = judged.select("doc_id", "toxic", F.when(F.col("quality") == 1, 1).otherwise(2).alias("revision"), "content_hash", "source_hash")
    evidence = given.groupBy("doc_id", "revision", "content_hash", "source_hash").agg(F.count("*").alias("judged"), F.sum("toxic").alias("against"))
    return hits(spark, sf_dir).join(evidence, ["doc_id", "revision", "content_hash", "source_hash"], "left").select("doc_id", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("against", F.lit(0)).alias("against"))


def cited(decisions: DataFrame, texts: DataFrame, pattern: str) -> DataFrame:
    """(decision, cites): other texts that name a decision. Ids are read from the texts and joined by equality."""
    named = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("decision"))
    found = named.join(decisions, "decision").filter("id <> own_id").groupBy("decision").agg(F.count("*").alias("cites"))
    return decisions.join(found, "decision", "left").select("decision", F.coalesce("cites", F.lit(0)).alias("cites"))


def j13(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    note = F.concat(F.lit("see DEC-"), F.expr("1000 + n_chars % 300"), F.lit(" and DEC-"), F.expr("1000 + doc_id"))
    decisions = d.select(F.concat(F.lit("DEC-"), F.expr("1000 + doc_id")).alias("decision"), F.col("doc_id").alias("own_id"))
    return cited(decisions, d.select(F.col("doc_id").alias("id"), note.alias("text")), "DEC-[0-9]+")


def j19(spark, sf_dir):
    """Orders that still cite a superseded part while another line contradicts with a current one."""
    old = F.col("p_size") > 25
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('R', 'A')").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), old.alias("old")), "l_partkey")
    cites = line.filter("l_returnflag = 'R' and old").select("l_orderkey", F.col("l_partkey").alias("superseded")).distinct()
    against = line.filter("l_returnflag = 'A' and not old").select("l_orderkey", F.col("l_partkey").alias("current")).distinct()
    return cites.join(against, "l_orderkey")


def d11(spark, sf_dir):
    """Three roll-ups that stay when rows are reaped: by day, by month and kind, and spend by month."""
    ev = events(spark, sf_dir)
    month = F.date_format("ts", "yyyy-MM").alias("key")
    daily = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("n")).select(F.lit("day").alias("rollup"), "key", "n")
    kinds = ev.groupBy(F.concat(F.date_format("ts", "yyyy-MM"), F.lit("/"), F.col("kind")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("month").alias("rollup"), "key", "n")
    spend = ev.groupBy(month).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("n")).select(F.lit("spend").alias("rollup"), "key", "n")
    return daily.union(kinds).union(spend)


def d17(spark, sf_dir):
    """A sweep: what moves from its tier, what is pruned and what stays, by grain."""
    c = consolidations(spark, sf_dir)
    to = demotion(age_days("day", AS_OF))
    action = F.when(to == "expired", "prune").when(to == "hot", "keep").otherwise(F.concat(F.lit("to_"), to))
    return c.groupBy("grain", action.alias("action")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def h04(spark, sf_dir):
    """The text of an event: a sentence by kind, else its properties."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("Error "), k)).when(F.col("event_type") == "purchase", F.concat(F.lit("Purchase of "), k)).when(F.col("event_type") == "view", F.concat(F.lit("Viewed "), k))
    return ev.select("event_id", F.coalesce(said, "props").alias("text"))


def h05(spark, sf_dir, most: int = 2000):
    """Documents for the index: long bodies are cut and marked, empty ones skipped."""
    d = table(spark, sf_dir, "documents").filter("trim(coalesce(text, '')) <> ''")
    return d.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("und"))).alias("title"), F.md5(F.left("text", F.lit(most))).alias("body"), (F.length("text") > most).alias("cut"))


def s08(spark, sf_dir):
    """The archive written by day and read back."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_events(events(spark, sf_dir), path)
    return scan_events(spark, path, F.col("kind") == "error").select("event_id", F.col("day").cast("string").alias("day"), "session_id")


_CONS = "with c as (select o_orderkey id, case o_orderstatus when 'F' then 'session' when 'O' then 'topic' else 'decision_trace' end grain, o_custkey//100 repo, o_orderpriority title, cast(o_orderdate as date) as day, cast(round(o_totalprice*100) as bigint) cents from orders) "
ENTRIES = {
    "F01_projection": Entry(f01, "with r as (select o_custkey id, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) revision, o_orderstatus status, round(o_totalprice,2) amount from orders), l as (select l_orderkey, count(distinct l_partkey) links from lineitem group by 1) select id, revision, status, amount, coalesce(links,0) links from (select * from r qualify revision=max(revision) over (partition by id)) left join l on l_orderkey=o_orderkey"),
    "F08_violations": Entry(f08, "select l_orderkey, l_linenumber, l_returnflag law, l_linestatus severity from lineitem where l_returnflag='R' and l_linestatus in ('F','O') and cast(l_shipdate as date)>=date '1995-01-01' and cast(l_shipdate as date)<date '1996-01-01'"),
    "F11_recent": Entry(f11, _CONS + "select id, grain from c where grain in ('session','topic') and repo=0 and day>=date '1996-01-01'"),
    "F12_search": Entry(f12, _CONS + "select id, repo from c where title='2-HIGH' and grain='topic'"),
    "F14_by_entity": Entry(f14, _CONS + "select 'repo' entity, '4' as value, count(*) n, max(id) last_id from c where repo=4 union all select 'grain', 'decision_trace', count(*), max(id) from c where grain='decision_trace' union all select 'function', 'urgent', count(*), max(id) from c where title ilike '%urgent%' union all select 'file', 'Low', count(*), max(id) from c where title ilike '%low%'"),
    "F26_triggers": Entry(f26, "select user_id session_id, count(*) as \"all\", count(*) filter (event_type='click') tool, count(*) filter (event_type='error') \"both\", count(*) filter (event_type<>'error' and cast(json_extract_string(props,'$.k') as int)%2=1) args from events group by 1"),
    "F31_markers": Entry(f31, "select source lane, count(*) filter (not (lang is null or coalesce(length(text),0)<40)) hits, count(*) filter (lang is null or coalesce(length(text),0)<40) notes from documents group by 1"),
    "F33_capped": Entry(f33, "select doc_id, left(lang,20) lang, n_chars, left(text,20) as text, left(source,20) source from documents"),
    "A26_lane_drops": Entry(a26, "with d as (select source, lang, coalesce(length(trim(text,' ')),0) n from documents) select source lane, count(*) hits, count(*) filter (n=0) as empty, count(*) filter (n>0 and n<200) short, count(*) filter (n>=200 and lang is null) as scope, count(*) filter (n>=200 and lang is not null) kept from d group by 1"),
    "A28_tasks": Entry(a28, "select o_orderstatus status, o_orderpriority phase, count(*) n from orders group by grouping sets ((o_orderstatus),(o_orderpriority),())"),
    "A32_divergence": Entry(a32, "with p as (select strftime(ts,'%Y-%m-%d %H') as hour, count(*) received, count(*) filter (event_type<>'error') archived, count(*) filter (event_type='error') delta from events group by 1) select *, delta-coalesce(lag(delta) over (order by hour),0) growth from p"),
    "A35_bundles": Entry(a35, "select conv_id, count(*) sections, count(*) filter (role='user') users, count(*) filter (role='assistant') assistants from conversations group by 1"),
    "K05_floor_top": Entry(k05, "select user_id session_id, event_id, row_number() over (partition by user_id order by value/100 desc, event_id) as rank from events where value/100>=0.6 qualify rank<=10"),
    "K10_recent": Entry(k10, _CONS + "select id, grain, cast(day as varchar) as day from c order by c.day desc, id limit 30"),
    "R22_similar": Entry(r22, "with s as (select a.vec_id q, b.vec_id doc_id, list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda x: x[1]::double*x[2]::double)) score from embeddings a join embeddings b on a.vec_id%50=0 and a.vec_id<>b.vec_id), t as (select q, doc_id, round(score,5) score from s qualify row_number() over (partition by q order by round(s.score,9) desc, doc_id)<=5) select q, doc_id, row_number() over (partition by q order by score desc, doc_id) as rank, score from t where score>=0.4 qualify rank<=3"),
    "W04_rerank": Entry(w04, "select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents where lang='en' and n_chars<2000 qualify rank<=8"),
    "W11_labels": Entry(w11, "with l as (select user_id session_id, max(epoch_us(ts)//1000) ms from events group by 1), a as (select session_id, ((select max(ms) from l)-ms)//1000 s from l) select session_id, case when s<60 then 'just now' when s<3600 then (s//60) || 'm ago' when s<86400 then (s//3600) || 'h ago' else (s//86400) || 'd ago' end seen from a"),
    "J09_evidence": Entry(j09, "select d.doc_id, count(l.doc_id) judged, cast(coalesce(sum(l.toxic),0) as bigint) against from documents d left join labels l on l.doc_id=d.doc_id and l.quality=1 and source is not null where text is not null group by 1"),
    "J13_cites": Entry(j13, "with d as (select 1000+doc_id id, 1000+n_chars%300 c from documents) select 'DEC-' || a.id decision, count(b.id) cites from d a left join d b on b.c=a.id and b.id<>a.id group by 1"),
    "J19_drift": Entry(j19, "with l as (select l_orderkey, l_partkey, l_returnflag f, p_size>25 old from lineitem join part on p_partkey=l_partkey) select distinct a.l_orderkey, a.l_partkey superseded, b.l_partkey as current from l a join l b on a.l_orderkey=b.l_orderkey and a.f='R' and a.old and b.f='A' and not b.old"),
    "D11_reap": Entry(d11, "select 'day' as rollup, strftime(ts,'%Y-%m-%d') as key, count(*) n from events group by 2 union all select 'month', strftime(ts,'%Y-%m') || '/' || event_type, count(*) from events group by 2 union all select 'spend', strftime(ts,'%Y-%m'), cast(sum(cast(round(value*100) as bigint)) as bigint) from events group by 2"),
    "D17_sweep": Entry(d17, _CONS + ", a as (select *, datediff('day', day, date '1998-06-01') g from c) select grain, case when g<7 then 'keep' when g<90 then 'to_warm' when g<365 then 'to_cold' else 'prune' end as action, count(*) n, cast(sum(cents) as bigint) cents from a group by 1,2"),
    "H04_event_text": Entry(h04, "select event_id, case event_type when 'error' then 'Error ' || json_extract_string(props,'$.k') when 'purchase' then 'Purchase of ' || json_extract_string(props,'$.k') when 'view' then 'Viewed ' || json_extract_string(props,'$.k') else props end as text from events"),
    "H05_index_docs": Entry(h05, "select doc_id, coalesce(source,'') || '/' || coalesce(lang,'und') title, md5(left(text,2000)) body, length(text)>2000 cut from documents where trim(coalesce(text,''),' ')<>''"),
    "S08_read_back": Entry(s08, "select event_id, strftime(ts,'%Y-%m-%d') as day, user_id session_id from events where event_type='error'"),
}
