"""Functions over record fields: ids, times, weights, topics, paths and payload rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.functions.text import clamp_score, dot, words
from palimpsest.sources.tables import NOW, events, table

# Topics by the words that raise them, and phrases of questions about architecture.
TOPICS = [
    (r"\bgit\s+push\b", ["git", "git_push"]),
    (r"\bgit\s+commit\b", ["git", "git_commit"]),
    (r"\brefactor(ing|ed)?\b", ["refactor"]),
    (r"\bcargo\s+test\b", ["test", "ci"]),
    (r"\bpytest\b|\bjest\b", ["test"]),
    (r"\bdocker\b|\bcompose\b", ["deploy", "build"]),
    (r"\bbench(mark)?\b", ["perf", "test"]),
]
ARCHITECTURE = [
    "architecture", "subsystem", "system overview", "overview of the system", "how is the system structured", "how is the codebase structured", "how is the project structured",
    "structure of the codebase", "structure of the project", "major components", "main components", "how do the modules relate", "how do the components relate", "module map", "component map",
    "high-level design", "high level design", "birds-eye view", "bird's-eye view",
]
PATH_TOPICS = {
    "code": "rs ts tsx js jsx py go java c cc cpp h hpp rb kt swift scala cs php sh bash zsh fish ps1 sql proto tml".split(),
    "docs": "md mdx rst adoc asciidoc txt tex org".split(),
    "config": "toml yaml yml json ini cfg conf".split(),
}
CONFIDENCE = {"extracted": 1.0, "inferred": 0.7, "ambiguous": 0.4}


def topics(c: Column) -> Column:
    """The tags of all patterns that occur, whatever the case, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.when(c.rlike(f"(?i){p}"), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for p, tags in TOPICS])))


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last part, in lower case; null without one, or if nothing is before the dot."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def path_topic(path: Column) -> Column:
    ext = extension(path)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for topic, known in PATH_TOPICS.items():
        out = out.when(ext.isin(known), topic)
    return out


def confidence(score: Column, label: Column) -> Column:
    """A finite positive score, else the weight of the label, else 1."""
    out = F.when(score.isNotNull() & ~F.isnan(score) & (score > 0) & (F.abs(score) != float("inf")), score)
    for name, w in CONFIDENCE.items():
        out = out.when(label == name, w)
    return out.otherwise(1.0)


def clip_bytes(c: Column, n: int) -> Column:
    """The longest head of whole characters within ``n`` UTF-8 bytes."""
    head = F.substring(F.encode(c, "UTF-8"), 1, n)
    # continuation bytes of a character that was cut: its lead byte and what follows are taken off
    tail = F.hex(F.substring(head, -3, 3))
    cut = F.when(F.octet_length(c) <= n, 0).when(tail.rlike("[CDEF][0-9A-F]$"), 1).when(tail.rlike("[EF][0-9A-F][89AB][0-9A-F]$"), 2).when(tail.rlike("^F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F]$"), 3).otherwise(0)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(head, F.lit(1), F.lit(n) - cut), "UTF-8"))


def parsed_time(c: Column) -> Column:
    """RFC 3339 with any offset, else a date, else null; milliseconds since 1970."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def repo_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def partition_start(c: Column) -> Column:
    """The hour of an archive path year=/month=/day=/hour=."""
    part = lambda n: F.regexp_extract(c, n + "=([0-9]+)", 1)
    return F.try_to_timestamp(F.concat(part("year"), F.lit("-"), part("month"), F.lit("-"), part("day"), F.lit(" "), part("hour")), F.lit("yyyy-MM-dd HH"))


def c03(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm"))


_COMMANDS = ["git push origin", "Git  Commit -m x", "refactored it", "cargo test --all", "run PyTest now", "docker compose up", "benchmark", "dockerfile and digit pushing", "refactors benches"]
_EXTENSIONS = ["rs", "MD", "toml", "py", "txt", "weird", "sql", "Yaml", "tsx"]


def said() -> Column:
    """What is said and done: a command before each document."""
    return F.concat(F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.pmod("doc_id", F.lit(9)) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))


def c08(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(topics(said())).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def c09(spark, sf_dir):
    kind = F.col("kind")
    severity = F.when(kind == "error", "critical").when(kind.isin("purchase", "signup"), "notable").otherwise("info")
    pii = F.when(kind == "signup", "high").when(kind == "purchase", "medium").otherwise("low")
    return events(spark, sf_dir).groupBy(severity.alias("severity"), pii.alias("pii")).agg(F.count("*").alias("n"))


def c10(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.concat_ws(" ", F.lit("session"), F.col("session_id").cast("string"), F.col("kind"), F.concat(F.lit("#"), F.col("k").cast("string"))).alias("summary"))


def architecture(query: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in ARCHITECTURE]), lambda m: F.contains(F.lower(query), m))


def c15(spark, sf_dir):
    """Questions about the whole: some turns end in one of the phrases."""
    phrase = F.get(F.array(*[F.lit(m.upper()) for m in ARCHITECTURE]), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(40)).cast("int"))
    c = table(spark, sf_dir, "conversations").withColumn("query", F.concat("text", F.lit(" "), F.coalesce(phrase, F.lit(""))))
    return c.groupBy("role", architecture(F.col("query")).alias("architecture")).agg(F.count("*").alias("n"))


def c18(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2(F.concat_ws("|", "url", F.md5("html")), 256), 1, 16).alias("chunk_key"))


def c23(spark, sf_dir):
    path = F.date_format("ts", "'year='yyyy'/month='MM'/day='dd'/hour='HH")
    ev = events(spark, sf_dir).select(path.alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    cutoff = F.expr(f"timestamp'{NOW}' - interval 10 days")
    return ev.select("path", "n", F.when(partition_start(F.col("path")) + F.expr("interval 1 hour") <= cutoff, 1).otherwise(0).alias("expired"))


def c25(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return events(spark, sf_dir).select("event_id", parsed_time(stamp).alias("ms"))


def c26(spark, sf_dir):
    text = F.when(F.col("k") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("k") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("not a time")
    return events(spark, sf_dir).select("event_id", parsed_time(text).alias("ms"))


def c27(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def c28(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(clip_bytes(F.col("text"), 512)).cast("long").alias("bytes"), F.startswith("text", clip_bytes(F.col("text"), 512)).alias("head"))


def c31(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    life = F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderpriority") == "5-LOW", "abandoned").otherwise("open")
    start = F.coalesce(F.nullif(F.trim(F.when(F.col("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" ")), F.lit("")), F.lit("1970-01-01"))
    return o.groupBy(life.alias("lifecycle"), (start == "1970-01-01").alias("epoch")).agg(F.count("*").alias("n"))


def c32(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "extracted").when(F.col("l_returnflag") == "A", "inferred").otherwise("ambiguous")
    return li.groupBy("l_returnflag").agg(F.round(F.sum(confidence(F.col("l_discount"), label)), 4).alias("weight"))


def c35(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.round(F.sum(clamp_score(F.col("value") / 50)), 4).alias("score"), F.count_if(clamp_score(F.col("value") / 50) == 1).alias("full"))


def c36(spark, sf_dir):
    """Topics of paths by their endings; those that say nothing have none."""
    name = F.concat(F.lit("src.d/m"), "doc_id", F.coalesce(F.concat(F.lit("."), F.get(F.array(*map(F.lit, _EXTENSIONS)), F.pmod("doc_id", F.lit(11)).cast("int"))), F.lit("")))
    return table(spark, sf_dir, "documents").groupBy(path_topic(name).alias("topic")).agg(F.count("*").alias("n"))


def c37(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", repo_slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


def c38(spark, sf_dir):
    raw = table(spark, sf_dir, "events")
    return raw.select("event_id", F.concat(F.initcap("event_type"), F.lit(" "), F.get_json_object("props", "$.k")).alias("title"))


def c39(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[0-9]+\\.[0-9]+"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("mentions")).filter("mentions > 0")


def c40(spark, sf_dir):
    kind = F.when(F.startswith("p_type", F.lit("ECONOMY")), "card").when(F.startswith("p_type", F.lit("PROMO")), "decision").otherwise("chunk")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def c41(spark, sf_dir):
    w = F.filter(words("text"), lambda x: F.length(x) >= 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(w, 1, 16), " ").alias("tokens"))


def c42(spark, sf_dir):
    """Rules that a document breaks."""
    rules = [("empty", F.length(F.trim("text")) == 0), ("long", F.length("text") > 10000), ("language", ~F.col("lang").isin("en", "de")), ("size", F.col("n_chars") != F.length("text"))]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return table(spark, sf_dir, "documents").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_K = "cast(json_extract_string(props,'$.k') as int)"
SAID_SQL = f"{_COMMANDS}[doc_id%9+1] || ' ' || coalesce(text,'')"
TOPICS_SQL = "list_distinct(flatten([" + ", ".join(f"case when regexp_matches(t,'(?i){p}') then {tags} else [] end" for p, tags in TOPICS) + "]))"
_C08 = f"with s as (select {SAID_SQL} t from documents), u as (select unnest({TOPICS_SQL}) topic from s) select topic, count(*) n from u group by 1"
_MARKERS = ", ".join("'" + m.replace("'", "''") + "'" for m in ARCHITECTURE)
_C15 = f"with c as (select role, lower(text || ' ' || coalesce([{_MARKERS}][(conv_id*7+turn)%40+1],'')) q from conversations) select role, len(list_filter([{_MARKERS}], lambda m: contains(q,m)))>0 as architecture, count(*) n from c group by 1,2"
_C36 = f"with e as (select lower(coalesce({_EXTENSIONS}[doc_id%11+1],'')) x from documents) select case " + " ".join(f"when list_contains({known},x) then '{topic}'" for topic, known in PATH_TOPICS.items()) + " end topic, count(*) n from e group by 1"
ENTRIES = {
    "C03_norms": Entry(c03, "with e as (select vec_id, unnest(embedding)::double x from embeddings) select vec_id, round(sum(x*x),5) norm from e group by 1"),
    "C08_topics": Entry(c08, _C08),
    "C09_classes": Entry(c09, "select case event_type when 'error' then 'critical' when 'purchase' then 'notable' when 'signup' then 'notable' else 'info' end severity, case event_type when 'signup' then 'high' when 'purchase' then 'medium' else 'low' end pii, count(*) n from events group by 1,2"),
    "C10_summaries": Entry(c10, f"select event_id, concat_ws(' ','session',user_id,event_type,'#' || {_K}) summary from events"),
    "C15_architecture": Entry(c15, _C15),
    "C18_chunk_keys": Entry(c18, "select page_id, substr(sha256(url || '|' || md5(html)),1,16) chunk_key from pages"),
    "C23_partition_start": Entry(c23, "select strftime(ts,'year=%Y/month=%m/day=%d/hour=%H') path, count(*) n, case when max(date_trunc('hour',ts))+interval 1 hour<=timestamp '2024-01-22' then 1 else 0 end expired from events group by 1"),
    "C25_offsets": Entry(c25, "select event_id, epoch_ms(date_trunc('second',ts))-7200000 ms from events"),
    "C26_as_of": Entry(c26, f"select event_id, case {_K}%3 when 0 then epoch_ms(date_trunc('day',ts)) when 1 then epoch_ms(date_trunc('second',ts)) end ms from events"),
    "C27_days": Entry(c27, "select strftime(ts,'%Y-%m-%d') as day, count(*) n from events group by 1"),
    "C28_clipped": Entry(c28, "with d as (select doc_id, text, list_max(list_filter(range(0,least(length(text),512)+1), lambda i: octet_length(encode(left(text,i)))<=512)) i from documents) select doc_id, octet_length(encode(left(text,i))) bytes, true as head from d"),
    "C31_lifecycle": Entry(c31, "select case when o_orderstatus='F' then 'merged' when o_orderpriority='5-LOW' then 'abandoned' else 'open' end lifecycle, o_totalprice<=100000 epoch, count(*) n from orders group by 1,2"),
    "C32_confidence": Entry(c32, "select l_returnflag, round(sum(case when l_discount>0 then l_discount when l_returnflag='R' then 1.0 when l_returnflag='A' then 0.7 else 0.4 end),4) weight from lineitem group by 1"),
    "C35_clamped": Entry(c35, "select event_type kind, round(sum(greatest(0,least(1,value/50))),4) score, count(*) filter (value/50>=1) as \"full\" from events group by 1"),
    "C36_path_topics": Entry(c36, _C36),
    "C37_slugs": Entry(c37, "select p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name),'[^a-z0-9]+','-','g'),'^-|-$','','g') slug from part"),
    "C38_titles": Entry(c38, "select event_id, upper(event_type[1]) || event_type[2:] || ' ' || json_extract_string(props,'$.k') title from events"),
    "C39_versions": Entry(c39, "select doc_id, len(regexp_extract_all(text,'[0-9]+\\.[0-9]+')) mentions from documents where len(regexp_extract_all(text,'[0-9]+\\.[0-9]+'))>0"),
    "C40_kinds": Entry(c40, "select case when p_type like 'ECONOMY%' then 'card' when p_type like 'PROMO%' then 'decision' else 'chunk' end kind, count(*) n from part group by 1"),
    "C41_first_tokens": Entry(c41, "select conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text),'[a-z0-9_]+'), lambda x: length(x)>=4)[1:16],' ') tokens from conversations"),
    "C42_broken_rules": Entry(c42, "select 'empty' rule, count(*) n from documents where length(trim(text))=0 having count(*)>0 union all select 'long', count(*) from documents where length(text)>10000 having count(*)>0 union all select 'language', count(*) from documents where lang not in ('en','de') having count(*)>0 union all select 'size', count(*) from documents where n_chars<>length(text) having count(*)>0"),
}
