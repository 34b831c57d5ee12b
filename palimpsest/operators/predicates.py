"""Row predicates: scope, access, outcome and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.functions.records import extension
from palimpsest.sources.tables import events, table


def conjunction(parts: list[Column | None]) -> Column:
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def scope(repo: str | None = None, since_ms: int | None = None, topics: list[str] | None = None, prefixes: list[str] | None = None, *, repo_col="repo", ts_col="ts", topic_col="topic", path_col="path") -> Column:
    """Every clause given must hold; a row without the attribute passes since, topic and path clauses."""
    return conjunction(
        [
            F.lower(repo_col) == repo.lower() if repo else None,
            (F.coalesce(F.col(ts_col), F.lit(0)) == 0) | (F.col(ts_col) >= since_ms) if since_ms is not None else None,
            F.col(topic_col).isNull() | F.col(topic_col).isin(topics) if topics else None,
            F.col(path_col).isNull() | reduce(lambda a, b: a | b, [F.col(path_col).startswith(p) for p in prefixes]) if prefixes else None,
        ]
    )


def readable(level: Column, needed: Column, clearance: int, grants: list[str], admin: bool = False) -> Column:
    """Level at most the clearance, and every compartment granted; '*' grants all, an administrator skips compartments."""
    held = F.array(*[F.lit(g) for g in grants]).cast("array<string>")
    inside = F.size(F.array_except(F.coalesce(needed, F.array().cast("array<string>")), held)) == 0
    return (F.coalesce(level, F.lit(0)) <= clearance) & (F.lit(admin or "*" in grants) | inside)


def readable_any(level: Column, needed: Column, clearance: int, grants: list[str]) -> Column:
    """The weaker index form: one compartment granted is enough."""
    held = F.array(*[F.lit(g) for g in grants]).cast("array<string>")
    empty = F.size(F.coalesce(needed, F.array().cast("array<string>"))) == 0
    return (F.coalesce(level, F.lit(0)) <= clearance) & (empty | F.arrays_overlap(needed, held))


def outcome_lists(outcome: Column, allow: list[str], deny: list[str]) -> Column:
    """Denied outcomes drop; a given allow list also drops rows without an outcome."""
    kept = F.coalesce(~outcome.isin(deny), F.lit(True)) if deny else F.lit(True)
    return kept & (F.coalesce(outcome.isin(allow), F.lit(False)) if allow else F.lit(True))


def facts(spark, sf_dir) -> DataFrame:
    """Documents with an access level from their labels and compartments from source and language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = (F.col("quality") + 2 * F.col("toxic")).cast("int")
    comps = F.when(F.col("toxic") == 1, F.array(F.lit("legal"), F.col("lang"))).when(F.col("quality") == 1, F.array("lang"))
    return d.select("doc_id", "lang", "source", level.alias("level"), comps.alias("compartments"))


def f15(spark, sf_dir):
    return facts(spark, sf_dir).filter(readable(F.col("level"), F.col("compartments"), 2, ["en", "fr"])).select("doc_id", "level")


def f16(spark, sf_dir):
    return facts(spark, sf_dir).filter(readable_any(F.col("level"), F.col("compartments"), 3, ["en", "fr"])).select("doc_id", "level")


def f18(spark, sf_dir):
    f = facts(spark, sf_dir)
    reason = F.when(F.coalesce("level", F.lit(0)) > 2, "level").when(~readable(F.col("level"), F.col("compartments"), 2, ["en", "fr"]), "compartment").otherwise("granted")
    return f.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def f34(spark, sf_dir):
    return facts(spark, sf_dir).filter(readable(F.col("level"), F.col("compartments"), 2, [], admin=True)).groupBy("lang").agg(F.count("*").alias("n"))


def f04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(scope("SRC3", topics=["en", "de"], repo_col="source", topic_col="lang")).select("doc_id", "source", "lang")


def f06(spark, sf_dir):
    ev = events(spark, sf_dir)
    kept = (F.col("kind") == "error") & F.col("ms").between(1704844800000, 1705449600000)
    return ev.filter(kept).select("event_id", "session_id", "ms")


def f20(spark, sf_dir):
    return events(spark, sf_dir).filter(outcome_lists(F.col("kind"), ["click", "purchase"], ["error"])).groupBy("kind").agg(F.count("*").alias("n"))


def f21(spark, sf_dir):
    return events(spark, sf_dir).filter(~F.col("kind").isin("view", "click")).select("event_id", "kind")


# Families by kind, and endings that tell where an artifact belongs.
FAMILIES = {
    "tool_call": "code", "decision": "decisions", "turn": "turns", "agent_call": "turns", "law": "governance", "law_violation": "governance", "analysis": "analyses",
    "knowledge": "knowledge", "learning": "learnings", "consolidation": "consolidations", "topic_card": "topic_cards", "memory": "misc",
}
CODE_ENDINGS = "rs ts tsx js jsx mjs cjs vue py go rb java kt scala c cc cpp h hpp cs swift php lua sh bash zsh ps1 fish sql proto".split()
DOC_ENDINGS = "md mdx markdown rst adoc asciidoc txt rtf tex org".split()


def family(kind: Column, topics: Column, path: Column) -> Column:
    """Where an event belongs: by its kind; artifacts by their path's ending, else by their topics, else nowhere special."""
    ext = extension(path)
    artifact = F.when(ext.isin(CODE_ENDINGS), "code").when(ext.isin(DOC_ENDINGS), "docs").when(F.array_contains(topics, "code"), "code").when(F.array_contains(topics, "doc") | F.array_contains(topics, "documentation"), "docs")
    out = F.when(kind == "artifact", F.coalesce(artifact, F.lit("misc")))
    for name, where in FAMILIES.items():
        out = out.when(kind == name, where)
    return out


_KINDS = ["artifact", "artifact", *FAMILIES]
_PATHS = ["a/b.RS", "readme.md", "x.bin", "Makefile", ".md", "notes.d/file"]
_TOPICS = [["code", "doc"], ["doc"], ["documentation", "x"], []]


def f22(spark, sf_dir):
    """Events as records of all kinds, with paths and topics: how many go to each family."""
    at = lambda xs, n: F.element_at(F.array(*xs), (F.pmod(n, F.lit(len(xs))) + 1).cast("int"))
    e = F.col("event_id")
    topics = at([F.array(*map(F.lit, t)).cast("array<string>") for t in _TOPICS], F.floor(e / 84))
    found = family(at([F.lit(k) for k in _KINDS], e), topics, at([F.lit(p) for p in _PATHS], F.floor(e / 14)))
    return table(spark, sf_dir, "events").groupBy(found.alias("family")).agg(F.count("*").alias("n"))


def f25(spark, sf_dir, n: int = 50):
    ev = events(spark, sf_dir).filter(F.col("kind").isin("error", "signup"))
    return ev.orderBy(F.desc("ms"), F.desc("event_id")).limit(n).select("event_id", "session_id", "kind", "ms")


def laws(spark) -> DataFrame:
    """A small fixed rule book: an empty trigger matches everything."""
    rows = [("L1", "error", None, "block"), ("L2", "PURCHASE", "9", "warn"), ("L3", None, "^1", "note")]
    return spark.createDataFrame(rows, "law_id string, tool string, args string, verdict string")


def f27(spark, sf_dir):
    ev = events(spark, sf_dir)
    rules = F.broadcast(laws(spark))  # a handful of rules
    match = (F.col("tool").isNull() | (F.lower("tool") == F.lower("kind"))) & (F.col("args").isNull() | F.regexp(F.col("k").cast("string"), F.col("args")))
    return ev.join(rules, match).select("event_id", "law_id", "verdict")


def f29(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keep = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") | (F.col("o_totalprice") < 50000)
    return o.filter(keep).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def f30(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.length(F.trim("text")) > 0).groupBy("role").agg(F.count("*").alias("n"))


_FACTS = "with f as (select doc_id, lang, source, quality+2*toxic as level, case when toxic=1 then ['legal',lang] when quality=1 then [lang] end comps from documents left join labels using(doc_id)) "
_IN = "list_has_all(['en','fr'], coalesce(comps, []))"
_F22 = f"""with e as (select {_KINDS}[event_id%{len(_KINDS)}+1] kind, {_PATHS}[event_id//14%{len(_PATHS)}+1] path, {_TOPICS}[event_id//84%{len(_TOPICS)}+1] topics from events),
x as (select *, lower(regexp_extract(path,'[^/]\\.([^./]+)$',1)) ext from e)
select case {' '.join(f"when kind='{k}' then '{v}'" for k, v in FAMILIES.items())} when list_contains({CODE_ENDINGS},ext) then 'code' when list_contains({DOC_ENDINGS},ext) then 'docs'
when list_contains(topics,'code') then 'code' when list_contains(topics,'doc') or list_contains(topics,'documentation') then 'docs' else 'misc' end family, count(*) n from x group by 1"""
ENTRIES = {
    "F04_scope": Entry(f04, "select doc_id, source, lang from documents where lower(source)='src3' and lang in ('en','de')"),
    "F06_tool_calls": Entry(f06, "select event_id, user_id session_id, (epoch_us(ts)//1000) ms from events where event_type='error' and (epoch_us(ts)//1000) between 1704844800000 and 1705449600000"),
    "F15_access": Entry(f15, _FACTS + f"select doc_id, level from f where coalesce(level,0)<=2 and {_IN}"),
    "F16_access_any": Entry(f16, _FACTS + "select doc_id, level from f where coalesce(level,0)<=3 and (len(coalesce(comps,[]))=0 or list_has_any(comps,['en','fr']))"),
    "F18_access_reasons": Entry(f18, _FACTS + f"select case when coalesce(level,0)>2 then 'level' when not {_IN} then 'compartment' else 'granted' end reason, count(*) n from f group by 1"),
    "F20_outcomes": Entry(f20, "select event_type kind, count(*) n from events where event_type in ('click','purchase') group by 1"),
    "F21_low_signal": Entry(f21, "select event_id, event_type kind from events where event_type not in ('view','click')"),
    "F22_family": Entry(f22, _F22),
    "F25_browse": Entry(f25, "select event_id, user_id session_id, event_type kind, (epoch_us(ts)//1000) ms from events where event_type in ('error','signup') order by (epoch_us(ts)//1000) desc, event_id desc limit 50"),
    "F27_laws": Entry(f27, "with e as (select event_id, event_type kind, json_extract_string(props,'$.k') k from events) select event_id, 'L1' law_id, 'block' verdict from e where kind='error' union all select event_id,'L2','warn' from e where kind='purchase' and contains(k,'9') union all select event_id,'L3','note' from e where k like '1%'"),
    "F29_whitelist": Entry(f29, "select o_orderpriority, count(*) n from orders where o_orderpriority in ('1-URGENT','2-HIGH') or o_totalprice<50000 group by 1"),
    "F30_text_presence": Entry(f30, "select role, count(*) n from conversations where length(trim(text))>0 group by 1"),
    "F34_principal": Entry(f34, _FACTS + "select lang, count(*) n from f where coalesce(level,0)<=2 group by 1"),
}
