"""From a query's intent to lane requests, and what follows fusion: multipliers, trimming, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.functions.text import intent, intent_sql, outcome_factor, words
from palimpsest.operators.fulltext import Index, containing, documents_index, ranked_top, search_all
from palimpsest.operators.retrieval import _ALL, _AND, _Q, decay, ranked, rrf
from palimpsest.sources.tables import events, table

# Lanes of each intent with the collections they ask, the share of the budget and the limit.
PLANS = {
    "pre_change_context": [("vector", "code", 40, 20), ("keyword", "docs", 40, 20), ("graph", "imports", 20, 20)],
    "decision_lookup": [("vector", "decisions", 40, 20), ("keyword", "decisions", 40, 20), ("graph", "supersedes", 20, 20)],
    "similar_problems": [("vector", "turns", 50, 20), ("keyword", "turns", 25, 20), ("graph", "touched", 25, 20)],
    "law_check": [("keyword", "laws", 60, 20), ("graph", "violations", 40, 20)],
    "explain": [("vector", "docs", 50, 8), ("keyword", "docs", 50, 8)],
}


def plan_table(spark) -> DataFrame:
    rows = [(i, *lane) for i, lanes in PLANS.items() for lane in lanes]
    return spark.createDataFrame(rows, "intent string, lane string, collection string, share int, k int")


def lane_requests(queries: DataFrame, budget: int = 4000) -> DataFrame:
    """(q, intent, lane, collection, k, tokens): the requests that each query (q, query) makes."""
    asked = queries.withColumn("intent", intent("query"))
    plans = F.broadcast(plan_table(queries.sparkSession))  # the fixed plans
    return asked.join(plans, "intent").select("q", "intent", "lane", "collection", "k", (F.col("share") * budget / 100).cast("long").alias("tokens"))


def hit_factor(outcome: Column, repo: Column, active_repo: str | None = None, foreign: float = 0.0, session: Column | None = None, active_session: int | None = None) -> Column:
    """Factor of a hit: outcome, another repository (off without an active one), the same session twice."""
    out = outcome_factor(outcome)
    if active_repo is not None:
        out = out * F.when(F.lower(repo) == active_repo.lower(), 1.0).otherwise(foreign)
    if active_session is not None and session is not None:
        out = out * F.when(session == active_session, 2.0).otherwise(1.0)
    return out


def hybrid(index: Index, queries: DataFrame, n: int = 10, alpha: float = 0.7) -> DataFrame:
    """(q, rank, doc_id, score): the keyword and exact lanes that each query's plan asks for, fused and cut.

    Lanes are ranked on their own over a stored index; a lane that the plan lacks adds nothing.
    """
    asked = lane_requests(queries).filter("lane = 'keyword'").select("q", "k")
    words_lane = ranked_top(index, queries, 100).join(asked, "q").filter("rank <= k").select("q", F.lit("keyword").alias("lane"), "rank", "doc_id", (F.col("score") / 100).alias("native"))
    exact = ranked(search_all(index, queries), n=20).select("q", F.lit("exact").alias("lane"), "rank", "doc_id", (F.col("score") / 2).alias("native"))
    return ranked(rrf(words_lane.unionByName(exact), alpha=alpha), n=n).select("q", "rank", "doc_id", "score")


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("text").alias("query"))


def r07(spark, sf_dir):
    return lane_requests(_turns(spark, sf_dir)).groupBy("intent", "lane", "collection").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.max("k").alias("k"))


def r15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "success")
    factor = hit_factor(outcome, F.col("source"), "src3", 0.25, F.col("doc_id") % 10, 7)
    return d.select("doc_id", F.round(factor, 6).alias("factor"))


def r19(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    part = F.when(F.col("source") == "src0", "consolidation").when(F.col("source").startswith("src1"), "card").otherwise("snippet")
    return d.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def r20(spark, sf_dir):
    """Links of pages, with whether a page of that address is known."""
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("link")).withColumn("host", host("link"))
    known = p.select(host("url").alias("host")).distinct().withColumn("known", F.lit(True))
    return links.join(known, "host", "left").select("page_id", "link", F.coalesce("known", F.lit(False)).alias("exists"))


def r21(spark, sf_dir, n: int = 20):
    """Recall of each session: its purchases first, then its most recent events up to ``n``."""
    ev = events(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy(F.col("kind") != "purchase", F.desc("ms"), F.desc("event_id"))
    return ev.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select("session_id", "pos", "event_id")


def served(lanes: DataFrame, about: DataFrame, rate: float, active_repo: str, foreign: float, active_session: str, n: int = 10) -> DataFrame:
    """(q, rank, doc_id, score): lanes fused as they are served, from ``about`` (doc_id, text, age_days, repo, session, outcome).

    Hits without text are dropped before they take part; what is left is fused by reciprocal ranks and multiplied by its
    recency, its repository, its session and its outcome. Ranks are those of the lanes as they came.
    """
    known = about.filter(F.trim("text") != "").select("doc_id", "age_days", "repo", "session", "outcome")
    factor = decay(F.col("age_days"), rate) * hit_factor(F.col("outcome"), F.col("repo"), active_repo, foreign, F.col("session"), active_session)
    return ranked(rrf(lanes.join(known, "doc_id"), factor=factor).filter("score > 0"), n=n)


def r01_served(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.array_join(words("text"), " ").alias("query"))
    a = ranked_top(index, q, 20).select("q", F.lit("words").alias("lane"), "rank", "doc_id", (F.col("score") / 50).alias("native"))
    b = ranked(search_all(index, q)).select("q", F.lit("exact").alias("lane"), "rank", "doc_id", (F.col("score") / 2).alias("native"))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    outcome = F.when(F.col("toxic") == 1, "error").when(F.col("toxic") == 0, "success").otherwise("unknown")
    about = table(spark, sf_dir, "documents").join(marks, "doc_id", "left").select("doc_id", "text", (F.col("doc_id") % 90).alias("age_days"), F.col("lang").alias("repo"), F.col("source").alias("session"), outcome.alias("outcome"))
    return served(a.unionByName(b), about, 0.02, "en", 0.25, "src0").select("q", "rank", "doc_id", F.round("score", 6).alias("score"))


def r25(spark, sf_dir):
    """How a passage meets a document: whole text, its source, or part of the text; the first counts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    d = table(spark, sf_dir, "documents")
    found = containing(documents_index(spark, sf_dir), d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("item_id").alias("q"), "passage"))
    hit = found.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id")).join(d, "doc_id").join(b, "item_id")
    how = F.when(F.col("text") == F.col("passage"), 3).when(F.col("source") == F.col("passage"), 2).otherwise(1)
    return hit.select("item_id", "doc_id", how.alias("how"))


def r26(spark, sf_dir):
    """Mean reciprocal rank and recall of known passages under the hybrid plan, against the acceptance floors."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.array_join(words("text"), " ").alias("query"))
    truth = r25(spark, sf_dir).select(F.col("item_id").alias("q"), "doc_id")
    hits = hybrid(documents_index(spark, sf_dir), q)
    per = truth.join(hits, ["q", "doc_id"], "left").groupBy("q").agg(F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), (F.count("rank") / F.count("*")).alias("recall"))
    both = per.agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("recall"), 4).alias("recall"))
    return both.withColumn("passed", (F.col("mrr") >= 0.45) & (F.col("recall") >= 0.45))


def r28(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.row_number().over(w).alias("version"), F.length("text").cast("long").alias("size"), (F.length("text") - F.lag(F.length("text")).over(w)).cast("long").alias("change"))


def total_order() -> list[Column]:
    """Score, then newness, then severity, then id."""
    severity = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "notable", 1).otherwise(0)
    return [F.desc("score"), F.desc("ms"), severity.desc(), F.asc("event_id")]


def k01(spark, sf_dir, n: int = 200):
    severity = F.when(F.col("kind") == "error", "critical").when(F.col("kind") == "purchase", "notable").otherwise("info")
    ev = events(spark, sf_dir).select("event_id", F.round("value").alias("score"), F.expr("ms div 3600000").alias("ms"), severity.alias("severity"))
    return ev.orderBy(*total_order()).limit(n)


def k03(spark, sf_dir, n: int = 10, candidates: int = 100):
    """Of the first candidates by score, those that lead once outcomes are weighed in."""
    top = events(spark, sf_dir).orderBy(F.desc("value"), "event_id").limit(candidates)
    score = F.round(F.col("value") * outcome_factor(F.col("outcome")), 6).alias("score")
    return top.select("event_id", score).orderBy(F.desc("score"), "event_id").limit(n)


def k04(spark, sf_dir, n: int = 50):
    return events(spark, sf_dir).orderBy(F.desc("ms"), F.desc("event_id")).limit(n).select("event_id", "kind")


def k07(spark, sf_dir, k: int = 200):
    """The first ``k`` documents by size scored again by their share of distinct words."""
    d = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(k)
    w = words("text")
    return d.select("doc_id", F.round(F.size(F.array_distinct(w)) / F.size(w), 6).alias("score"))


def k09(spark, sf_dir, cap: int = 50):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return li.orderBy("l_partkey", "l_suppkey").limit(cap)


def trim_ladder(sizes: DataFrame, key: str, steps: list[tuple[str, Column]], budget: int) -> DataFrame:
    """(key, step, size): the first of the ordered reductions whose size fits, else the last."""
    tried = F.array(*[F.struct(F.lit(n).alias("step"), c.cast("long").alias("size")) for n, c in steps])
    fitting = F.filter(tried, lambda x: x["size"] <= budget)
    chosen = F.when(F.size(fitting) > 0, F.get(fitting, F.lit(0))).otherwise(F.element_at(tried, -1))
    return sizes.select(key, chosen.alias("c")).select(key, "c.step", "c.size")


def w10(spark, sf_dir):
    n = F.col("n_chars")
    steps = [("whole", n), ("half", F.floor(n / 2)), ("quarter", F.floor(n / 4)), ("head", F.least(n, F.lit(512)))]
    return trim_ladder(table(spark, sf_dir, "documents"), "doc_id", steps, 2000)


def f32(spark, sf_dir, budget: int = 32768):
    """Sections of a conversation's reply that still fit, from the last one backwards given up."""
    c = table(spark, sf_dir, "conversations").withColumn("bytes", F.least(F.octet_length("text"), F.lit(1024)).cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("used", F.sum("bytes").over(w)).filter(F.col("used") <= budget // 8).select("conv_id", "turn", "used")


_T = "with t as (select conv_id*1000+turn q, text from conversations where role='user'), i as (select q, " + intent_sql("text") + " intent from t), p(intent, lane, collection, share, k) as (values " + ", ".join(f"('{i}','{a}','{b}',{s},{k})" for i, lanes in PLANS.items() for a, b, s, k in lanes) + ") "
_SERVED = (
    _Q + _ALL + _AND + ", l as (select q, doc_id, rank, score/50 nat from br where rank<=20 union all select q, doc_id, row_number() over (partition by q order by score desc, doc_id) rank, score/2 from ls qualify rank<=20), "
    "x as (select doc_id, max(toxic) toxic from labels group by 1), ab as (select doc_id, exp(-0.02*(doc_id%90)) * case toxic when 1 then 0.5 when 0 then 1.2 else 1.0 end * case when lower(lang)='en' then 1.0 else 0.25 end * case when source='src0' then 2.0 else 1.0 end f from documents left join x using(doc_id) where trim(text)<>''), "
    "f as (select q, doc_id, sum(0.7/(60+rank)+0.3*greatest(0,least(1,nat)))*max(f) score from l join ab using(doc_id) group by 1,2) select q, row_number() over (partition by q order by round(score,9) desc, doc_id) rank, doc_id, round(score,6) score from f where score>0 qualify rank<=10"
)
ENTRIES = {
    "R01_served_fusion": Entry(r01_served, _SERVED),
    "R07_lane_requests": Entry(r07, _T + "select intent, lane, collection, count(*) requests, cast(sum(share*40) as bigint) tokens, max(k) k from i join p using(intent) group by 1,2,3"),
    "R15_multipliers": Entry(r15, "select doc_id, round((case when toxic=1 then 0.5 when quality=1 then 1.2 else 1.0 end)*(case when lower(source)='src3' then 1.0 else 0.25 end)*(case when doc_id%10=7 then 2.0 else 1.0 end),6)::double factor from documents join labels using(doc_id)"),
    "R19_partition": Entry(r19, "select case when source='src0' then 'consolidation' when source like 'src1%' then 'card' else 'snippet' end part, count(*) n, cast(sum(n_chars) as bigint) chars from documents group by 1"),
    "R20_phantoms": Entry(r20, "with l as (select distinct page_id, unnest(regexp_extract_all(html,'href=\"([^\"]*)\"',1)) link from pages), k as (select distinct regexp_extract(url,'^https?://([^/?#]+)',1) h from pages) select page_id, link, h is not null as \"exists\" from l left join k on h=regexp_extract(link,'^https?://([^/?#]+)',1)"),
    "R21_recall": Entry(r21, "select user_id session_id, row_number() over (partition by user_id order by event_type<>'purchase', epoch_us(ts)//1000 desc, event_id desc) pos, event_id from events qualify pos<=20"),
    "R25_matches": Entry(r25, "select item_id, doc_id, case when d.text=b.text then 3 when source=b.text then 2 else 1 end how from documents d join benchmark b on contains(d.text,b.text)"),
    "R26_acceptance": Entry(r26),
    "R28_versions": Entry(r28, "select conv_id, turn, row_number() over w as version, length(text) size, length(text)-lag(length(text)) over w as change from conversations window w as (partition by conv_id order by turn)"),
    "K01_total_order": Entry(k01, "select event_id, round(value) score, epoch_us(ts)//3600000000 ms, case event_type when 'error' then 'critical' when 'purchase' then 'notable' else 'info' end severity from events order by 2 desc, 3 desc, case event_type when 'error' then 2 when 'purchase' then 1 else 0 end desc, 1 limit 200"),
    "K03_two_stage": Entry(k03, "with t as (select * from events order by value desc, event_id limit 100) select event_id, round(value*case when event_type='error' then 0.5 else 1.2 end,6) score from t order by 2 desc, 1 limit 10"),
    "K04_recent": Entry(k04, "select event_id, event_type kind from events order by epoch_us(ts)//1000 desc, event_id desc limit 50"),
    "K07_rescored": Entry(k07, "with d as (select doc_id, regexp_extract_all(lower(text),'[a-z0-9_]+') w from documents order by n_chars desc, doc_id limit 200) select doc_id, round(len(list_distinct(w))/len(w),6) score from d"),
    "K09_merged": Entry(k09, "select distinct l_partkey, l_suppkey from lineitem order by 1,2 limit 50"),
    "W10_trim_ladder": Entry(w10, "select doc_id, case when n_chars<=2000 then 'whole' when n_chars//2<=2000 then 'half' when n_chars//4<=2000 then 'quarter' else 'head' end step, case when n_chars<=2000 then n_chars when n_chars//2<=2000 then n_chars//2 when n_chars//4<=2000 then n_chars//4 else least(n_chars,512) end as size from documents"),
    "F32_clipped": Entry(f32, "select conv_id, turn, cast(sum(least(octet_length(encode(text)),1024)) over (partition by conv_id order by turn rows unbounded preceding) as bigint) used from conversations qualify used<=4096"),
}
