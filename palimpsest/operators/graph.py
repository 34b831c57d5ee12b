"""Typed links: patches, bounded traversal, chains, communities and link hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.functions.similarity import jaro_winkler
from palimpsest.operators.joins import revisions
from palimpsest.operators.temporal import ancestry
from palimpsest.sources.shared import cut, spread
from palimpsest.sources.tables import events, table

# Link type by the flag of the line it comes from.
TYPES = {"R": "CALLS", "A": "CITES", "N": "IMPORTS"}


def links(spark, sf_dir) -> DataFrame:
    """(src, dst, type, weight): a part links to the part of the next line of its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem")
    lines = spread(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), lines.count(), "l_orderkey")
    li = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_returnflag", F.col("l_quantity").cast("long").alias("weight"))
    kind = F.when(F.col("l_returnflag") == "R", TYPES["R"]).when(F.col("l_returnflag") == "A", TYPES["A"]).otherwise(TYPES["N"])
    return li.filter("dst is not null and src <> dst").select("src", "dst", kind.alias("type"), "weight")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(node, hops): nodes within ``depth`` undirected hops of any seed (node), by the fewest hops.

    One join of the nodes met last a hop; a node keeps the hop it was met at, so cycles add nothing. Each hop is
    written, so that none is computed again by those after it.
    """
    both = cut(undirected(edges))
    last = known = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        step = last.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        last = cut(step.join(known.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        known = known.unionByName(last)
    return known


def previous_hops(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, hops, before): each reached node with the smallest node one hop nearer; paths follow ``before``."""
    nearer = reached.select(F.col("node").alias("src"), (F.col("hops") + 1).alias("hops"))
    step = undirected(edges).join(nearer, "src").select(F.col("dst").alias("node"), "hops", "src")
    return reached.join(step, ["node", "hops"], "left").groupBy("node", "hops").agg(F.min("src").alias("before"))


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size = 1 and p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node"))


def g01(spark, sf_dir):
    """Node and link rows of events: a session has events, an event is of a kind."""
    ev = events(spark, sf_dir)
    edge = lambda t, a, b: F.struct(F.lit(t).alias("type"), a.cast("string").alias("src"), b.cast("string").alias("dst"))
    e = ev.select(F.explode(F.array(edge("HAS_EVENT", F.col("session_id"), F.col("event_id")), edge("OF_KIND", F.col("event_id"), F.col("kind")))).alias("e"))
    return e.groupBy("e.type").agg(F.count("*").alias("n"), F.countDistinct("e.src").alias("sources"), F.countDistinct("e.dst").alias("targets"))


def g02(spark, sf_dir):
    return links(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def g06(spark, sf_dir):
    """Links whose ends both exist among the larger parts; the others are dropped."""
    big = table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey")
    e = links(spark, sf_dir)
    ok = e.join(big.select(F.col("p_partkey").alias("src")), "src", "left_semi").join(big.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return ok.groupBy("type").agg(F.count("*").alias("n"))


def coalesced(patches: DataFrame) -> DataFrame:
    """(label, key, prop, value): of the patches (label, key, prop, value, seq) the latest of each property."""
    return patches.groupBy("label", "key", "prop").agg(F.max_by("value", "seq").alias("value"))


def g07(spark, sf_dir):
    ev = events(spark, sf_dir)
    patches = ev.select(F.lit("Session").alias("label"), F.col("session_id").alias("key"), F.col("kind").alias("prop"), F.col("k").cast("string").alias("value"), "event_id")
    return coalesced(patches.withColumnRenamed("event_id", "seq"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, policy: str = "match") -> DataFrame:
    """Merged rows: ``match`` keeps what is there, ``replace`` takes what comes; other columns must agree."""
    if policy == "match":
        return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))
    if policy == "replace":
        return incoming.unionByName(existing.join(incoming.select(key), key, "left_anti"))
    raise ValueError(f"unknown policy {policy}")


def g08(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.filter("p_size > 20").select("p_partkey", F.lit("old").alias("origin"))
    new = p.filter("p_size < 30").select("p_partkey", F.lit("new").alias("origin"))
    both = upsert(old, new, "p_partkey").withColumn("policy", F.lit("match")).unionByName(upsert(old, new, "p_partkey", "replace").withColumn("policy", F.lit("replace")))
    return both.groupBy("policy", "origin").agg(F.count("*").alias("n"))


def g09(spark, sf_dir):
    return links(spark, sf_dir).filter("not (type = 'CITES' and weight < 10)").groupBy("type").agg(F.count("*").alias("n"))


def g10(spark, sf_dir):
    return reach(links(spark, sf_dir).filter("type = 'CALLS'"), _seeds(spark, sf_dir), 5)


def g11(spark, sf_dir):
    e = links(spark, sf_dir).filter("type = 'CITES'")
    return previous_hops(e, reach(e, _seeds(spark, sf_dir), 5))


def g12(spark, sf_dir):
    r = reach(links(spark, sf_dir), _seeds(spark, sf_dir), 2)
    return r.groupBy("hops").agg(F.count("*").alias("n"))


def g13(spark, sf_dir):
    """Blast radius: distinct nodes within two IMPORTS links against their direction."""
    e = cut(links(spark, sf_dir).filter("type = 'IMPORTS'").select("src", "dst").distinct())
    # how many trails of two links there are: as many as links that come in times links that go out, added up over the nodes
    into, out = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    trails = into.join(out, "node").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
    # trails leave a join of few links: it is dealt out by what it yields
    to, on = spread(e, trails, "dst"), spread(e.select(F.col("src").alias("via"), F.col("dst").alias("of")), trails, "via")
    two = on.join(to, F.col("via") == F.col("dst")).select("of", F.col("src").alias("hit"))
    hits = e.select(F.col("dst").alias("of"), F.col("src").alias("hit")).unionByName(two).filter("of <> hit")
    return spread(hits, trails, "of").distinct().groupBy("of").agg(F.count("*").alias("n"))


def g14(spark, sf_dir):
    return links(spark, sf_dir).filter("type = 'CALLS'").groupBy("dst").agg(F.countDistinct("src").alias("callers"), F.sum("weight").alias("weight"))


def g15(spark, sf_dir):
    """Trails of up to four CITES links from each seed, by their length and end: how many, and the first of them."""
    e = links(spark, sf_dir).filter("type = 'CITES'").select("src", "dst").distinct()
    trail = _seeds(spark, sf_dir).select(F.array("node").alias("path"))
    found = None
    for _ in range(4):
        last = F.element_at("path", -1)
        trail = trail.withColumn("end", last).join(e, F.col("end") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = trail if found is None else found.unionByName(trail)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    ends = found.groupBy((F.size("path") - 1).cast("long").alias("hops"), F.element_at("path", 1).alias("seed"), F.element_at("path", -1).alias("end"))
    return ends.agg(F.count("*").alias("trails"), F.min(path).alias("path"))


def chain_counts(r: DataFrame, cap: int) -> DataFrame:
    """Revisions before and after each, at most ``cap`` of each."""
    n = F.count("*").over(Window.partitionBy("id"))
    return r.select("id", "revision", F.least(F.col("revision") - 1, F.lit(cap)).cast("long").alias("before"), F.least(n - F.col("revision"), F.lit(cap)).cast("long").alias("after"))


def g16(spark, sf_dir):
    return chain_counts(revisions(spark, sf_dir), 16)


def g17(spark, sf_dir):
    """Supersession closure of up to eight steps: which order replaces which."""
    w = Window.partitionBy("id").orderBy("revision")
    parents = revisions(spark, sf_dir).select(F.col("source_id").alias("node"), F.lag("source_id").over(w).alias("parent"))
    return ancestry(cut(parents), 3).groupBy("depth").agg(F.count("*").alias("n"))


def g18(spark, sf_dir, cap: int = 32):
    """Each order's line of decisions backwards, newest first, at most ``cap``."""
    w = Window.partitionBy("id").orderBy("revision").rowsBetween(-cap + 1, 0)
    line = F.array_join(F.transform(F.reverse(F.collect_list("source_id").over(w)), lambda x: x.cast("string")), ">")
    return revisions(spark, sf_dir).select("source_id", F.md5(line).alias("chain"))


#: Rounds of votes of all community queries: more no longer settle, as rows of equal weight swap labels for ever.
ROUNDS = 3


def propagate_labels(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): each round every node takes the label of the largest weight among its neighbours, ties the smallest.

    A round is one join by neighbour, whose votes are sent once, by node; both are dealt out by the number of links.
    """
    w = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))
    w = cut(w)
    n = 2 * w.count()
    both = w.select(F.col("a").alias("node"), F.col("b").alias("near"), "weight").unionByName(w.select(F.col("b").alias("node"), F.col("a").alias("near"), "weight"))
    by_near = spread(both, n, "near")
    # at first every node has its own label, so that links are votes as they stand
    votes = spread(both.select("node", F.col("near").alias("label"), "weight"), n, "node")
    labels = None
    for _ in range(rounds):
        if labels is not None:
            votes = spread(by_near.join(labels.select(F.col("node").alias("near"), "label"), "near").select("node", "label", "weight"), n, "node")
        summed = votes.groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        labels = cut(summed.groupBy("node").agg(F.min_by("label", F.struct(-F.col("weight"), "label")).alias("label")))
    return both.select("node").distinct().withColumn("label", F.col("node")) if labels is None else labels


def g19(spark, sf_dir):
    return propagate_labels(links(spark, sf_dir))


def a34(spark, sf_dir):
    """Communities with their size and the links that leave them."""
    e = links(spark, sf_dir)
    labels = propagate_labels(e)
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    ends = e.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    out = ends.filter("a <> b").groupBy(F.col("a").alias("label")).agg(F.count("*").alias("leaving"))
    return size.join(out, "label", "left").select("label", "size", F.coalesce("leaving", F.lit(0)).alias("leaving"))


def c30(spark, sf_dir):
    """Similarity of each distinct part name to the one before it."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    w = Window.orderBy("p_name")  # distinct names are a few dozen
    pairs = names.withColumn("other", F.lag("p_name").over(w)).filter("other is not null")
    return pairs.select("p_name", "other", F.round(jaro_winkler("p_name", "other"), 6).alias("score"))


def g22(spark, sf_dir):
    """Contradictions by detector: changed status, changed kind, falling amount between neighbouring revisions."""
    w = Window.partitionBy("id").orderBy("revision")
    r = revisions(spark, sf_dir).select("id", *[F.struct(F.lag(c).over(w).alias("a"), F.col(c).cast(t).alias("b")).alias(c) for c, t in (("status", "string"), ("kind", "string"), ("amount", "double"))])
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in (("status", F.expr("status.a <> status.b")), ("kind", F.expr("kind.a <> kind.b")), ("amount", F.expr("amount.b < amount.a / 2")))])
    return r.select(F.explode(F.array_compact(flags)).alias("detector")).groupBy("detector").agg(F.count("*").alias("n"))


def g23(spark, sf_dir):
    """Typed links between neighbouring revisions."""
    w = Window.partitionBy("id").orderBy("revision")
    r = revisions(spark, sf_dir).withColumns({"prior": F.lag("source_id").over(w), "was": F.lag("status").over(w)}).filter("prior is not null")
    kind = F.when(F.col("status") == F.col("was"), "EVOLVES_FROM").when(F.col("status") == "F", "OBSOLETES").otherwise("CONFLICTS_WITH")
    return r.select(F.col("source_id").alias("src"), F.col("prior").alias("dst"), kind.alias("type"))


def g24(spark, sf_dir):
    """Links from sources to the languages they cite, by a dictionary."""
    known = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "lang string, project string")
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(known), "lang").select("source", "project", "n")  # three rows


def g31(spark, sf_dir):
    """Texts to index again: those whose content is not among the labelled ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    seen = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("hash")
    return d.join(seen, "hash", "left_anti").select("doc_id", "hash")


def g32(spark, sf_dir):
    e = links(spark, sf_dir).withColumn("dst", F.when(F.col("weight") < 3, F.concat(F.lit("pending|"), F.col("dst"))).otherwise(F.col("dst").cast("string")))
    return e.filter(~F.col("dst").startswith("pending|")).groupBy("type").agg(F.count("*").alias("n"))


def g33(spark, sf_dir):
    labels = propagate_labels(links(spark, sf_dir))
    return table(spark, sf_dir, "part").join(labels, F.col("p_partkey") == F.col("node"), "left").select("p_partkey", F.coalesce("label", F.lit(-1)).alias("community"))


def g34(spark, sf_dir, cap: int = 50):
    w = Window.partitionBy("type").orderBy(F.desc("weight"), "src", "dst")
    e = links(spark, sf_dir).groupBy("type", "src", "dst").agg(F.sum("weight").alias("weight"))
    return e.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap)


_L = "with recursive li as (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) dst, case l_returnflag when 'R' then 'CALLS' when 'A' then 'CITES' else 'IMPORTS' end as type, cast(l_quantity as bigint) weight from lineitem), e as (select * from li where dst is not null and src<>dst), sd as (select p_partkey node from part where p_size=1 and p_brand='Brand#2'), "
_UND = "u as (select src, dst from e where {w} union select dst, src from e where {w}), b(node, hops) as (select node, 0 from sd union select dst, hops+1 from b join u on src=node where hops<{d}), m as (select node, min(hops) hops from b group by 1) "
_R = "with r as (select o_custkey id, row_number() over w revision, o_orderkey source_id, o_orderstatus status, o_orderpriority kind, round(o_totalprice,2) amount, lag(o_orderkey) over w prior, lag(o_orderstatus) over w was, lag(o_orderpriority) over w wask, lag(round(o_totalprice,2)) over w wasa from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) "
_LP = "w as (select least(src,dst) a, greatest(src,dst) b, sum(weight) weight from e group by 1,2), n as (select a node, b near, weight from w union all select b, a, weight from w), l0 as (select distinct node, node as label from n)"


def _round(k: int) -> str:
    return f", v{k} as (select n.node, label, sum(weight) weight from n join l{k - 1} l on l.node=n.near group by 1,2), l{k} as (select node, arg_min(label,(-weight,label)) as label from v{k} group by 1)"


_ROUNDS = "".join(_round(k) for k in range(1, ROUNDS + 1))
ENTRIES = {
    "G01_patches": Entry(g01, "select 'HAS_EVENT' as type, count(*) n, count(distinct user_id) sources, count(distinct event_id) targets from events union all select 'OF_KIND', count(*), count(distinct event_id), count(distinct event_type) from events"),
    "G02_edge_kinds": Entry(g02, _L + "z as (select 1) select type, count(*) n, cast(sum(weight) as bigint) weight from e group by 1"),
    "G06_resolved": Entry(g06, _L + "p as (select p_partkey from part where p_size>10) select type, count(*) n from e where src in (from p) and dst in (from p) group by 1"),
    "G07_coalesced": Entry(g07, "select 'Session' as label, user_id as key, event_type prop, arg_max(json_extract_string(props,'$.k'), event_id) as value from events group by 2,3"),
    "G08_upserts": Entry(g08, "select 'match' as policy, case when p_size>20 then 'old' else 'new' end origin, count(*) n from part where p_size>20 or p_size<30 group by 2 union all select 'replace', case when p_size<30 then 'new' else 'old' end, count(*) from part where p_size>20 or p_size<30 group by 2"),
    "G09_deleted": Entry(g09, _L + "z as (select 1) select type, count(*) n from e where not (type='CITES' and weight<10) group by 1"),
    "G10_reach": Entry(g10, _L + _UND.format(w="type='CALLS'", d=5) + "select node, hops from m"),
    "G11_shortest": Entry(g11, _L + _UND.format(w="type='CITES'", d=5) + ", q as (select m.node, m.hops, min(p.node) before from m left join (select u.dst, m.node, m.hops from u join m on u.src=m.node) p on p.dst=m.node and p.hops=m.hops-1 group by 1,2) select * from q"),
    "G12_k_hop": Entry(g12, _L + _UND.format(w="true", d=2) + "select hops, count(*) n from m group by 1"),
    "G13_blast_radius": Entry(g13, _L + "i as (select distinct src, dst from e where type='IMPORTS'), h as (select dst as \"of\", src hit from i union select b.dst, a.src from i a join i b on a.dst=b.src) select \"of\", count(*) n from h where \"of\"<>hit group by 1"),
    "G14_callers": Entry(g14, _L + "z as (select 1) select dst, count(distinct src) callers, cast(sum(weight) as bigint) weight from e where type='CALLS' group by 1"),
    "G15_trails": Entry(g15, _L + "i as (select distinct src, dst from e where type='CITES'), t(p, h) as (select [node], 0 from sd union all select list_append(p, dst), h+1 from t join i on i.src=p[-1] where h<4 and not list_contains(p,dst)) select cast(h as bigint) hops, p[1] seed, p[-1] as \"end\", count(*) trails, min(array_to_string(p,'>')) path from t where h>0 group by 1,2,3"),
    "G16_chain": Entry(g16, _R + "select id, revision, least(revision-1,16) as before, least(count(*) over (partition by id)-revision,16) as after from r"),
    "G17_supersedes": Entry(g17, _R + "select b.revision-a.revision as depth, count(*) n from r a join r b on a.id=b.id and b.revision-a.revision between 1 and 8 group by 1"),
    "G18_decisions": Entry(g18, _R + "select source_id, md5(array_to_string(list_reverse(list(source_id) over (partition by id order by revision rows between 31 preceding and current row)),'>')) as chain from r"),
    "G19_communities": Entry(g19, _L + _LP + _ROUNDS + " select node, label from l3"),
    "A34_community_stats": Entry(a34, _L + _LP + _ROUNDS + ", s as (select label, count(*) size from l3 group by 1), o as (select a.label, count(*) leaving from e join l3 a on a.node=src join l3 b on b.node=dst where a.label<>b.label group by 1) select s.label, size, coalesce(leaving,0) leaving from s left join o using(label)"),
    "C30_jaro_winkler": Entry(c30, "with n as (select distinct p_name from part), p as (select p_name, lag(p_name) over (order by p_name) other from n) select p_name, other, round(jaro_winkler_similarity(p_name, other),6) score from p where other is not null"),
    "G22_contradictions": Entry(g22, _R + "select 'status' detector, count(*) n from r where was<>status union all select 'kind', count(*) from r where wask<>kind union all select 'amount', count(*) from r where amount<wasa/2"),
    "G23_temporal_links": Entry(g23, _R + "select source_id src, prior dst, case when status=was then 'EVOLVES_FROM' when status='F' then 'OBSOLETES' else 'CONFLICTS_WITH' end as type from r where prior is not null"),
    "G24_cross_project": Entry(g24, "select source, case lang when 'en' then 'English' when 'de' then 'German' else 'French' end project, count(*) n from documents where lang in ('en','de','fr') group by 1,2"),
    "G31_reindex": Entry(g31, "select doc_id, md5(text) hash from documents where md5(text) not in (select md5(text) from documents join labels using(doc_id))"),
    "G32_no_pending": Entry(g32, _L + "z as (select 1) select type, count(*) n from e where weight>=3 group by 1"),
    "G33_writeback": Entry(g33, _L + _LP + _ROUNDS + " select p_partkey, coalesce(label,-1) community from part left join l3 on node=p_partkey"),
    "G34_capped": Entry(g34, _L + "g as (select type, src, dst, cast(sum(weight) as bigint) weight from e group by 1,2,3) select *, row_number() over (partition by type order by weight desc, src, dst) pos from g qualify pos<=50"),
}
