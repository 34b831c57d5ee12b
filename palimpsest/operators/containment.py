"""Joins by containment: which of many fragments a text contains, and what that resolves.

A fragment begins with a gram. Where a text has the first gram of some fragment, the stretches from there that are as
long as a fragment of that gram are compared whole, by one equi-join. Fragments shorter than a gram are grams of their own
length. No fragment meets a text that does not contain it, however many fragments share their grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Entry
from palimpsest.sources.shared import cut
from palimpsest.sources.tables import table

GRAM = 4


def _places(c: Column, size: int, longest: int) -> Column:
    """The grams of ``c``, each with the stretch of ``longest`` that it begins."""
    last = F.length(c) - size + 1
    of = lambda i: F.struct(F.substring(c, i, F.lit(size)).alias("start"), F.substring(c, i, F.lit(longest)).alias("stretch"))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), of))


def contained(texts: DataFrame, fragments: DataFrame, gram: int = GRAM) -> DataFrame:
    """(id, fragment): each fragment that a text (id, text) contains. Null and empty fragments are contained in nothing.

    What is sent grows with the places at which some fragment could begin, times the lengths of fragments that begin so.
    """
    fragments = cut(fragments.select("fragment").filter("fragment <> ''").distinct())
    size = F.least(F.length("fragment"), F.lit(gram))
    starts = fragments.groupBy(F.substring("fragment", F.lit(1), size).alias("start")).agg(F.collect_set(F.length("fragment")).alias("sizes"))
    starts = cut(starts)
    # at most ``gram`` numbers
    known = starts.groupBy(F.length("start").alias("n")).agg(F.max(F.array_max("sizes")).alias("longest")).orderBy("n").collect()
    if not known:
        return texts.select("id", F.col("text").alias("fragment")).limit(0)
    places = F.flatten(F.array(*[F.coalesce(_places(F.col("text"), *r), F.array().cast("array<struct<start:string,stretch:string>>")) for r in known]))
    begun = texts.filter("text is not null").select("id", F.explode(places).alias("p")).select("id", "p.*")
    whole = begun.join(starts, "start").select("id", "stretch", F.explode("sizes").alias("n"))
    parts = whole.select("id", F.expr("substring(stretch, 1, n)").alias("fragment"))
    return parts.join(fragments, "fragment", "left_semi").select("id", "fragment").distinct()


def resolve_keys(keys: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, decision): the decision that a key (``repo|path`` or a path) names: one whose id is the path, letter case
    aside, else the first in order of those whose ids it contains. Keys that name none are left out."""
    path = F.lower(F.when(F.contains("key", F.lit("|")), F.expr("substring(key, instr(key, '|') + 1)")).otherwise(F.col("key")))
    paths = cut(keys.select("key").distinct().filter("key is not null").withColumn("path", path))
    known = decisions.select(F.lower("decision").alias("fragment"), "decision").groupBy("fragment").agg(F.min("decision").alias("decision"))
    exact = paths.join(known, F.col("path") == F.col("fragment")).select("key", "decision")
    rest = paths.join(known.select("fragment"), F.col("path") == F.col("fragment"), "left_anti")
    texts = rest.select(F.col("path").alias("id"), F.col("path").alias("text")).distinct()
    first = contained(texts, known.select("fragment")).groupBy("id").agg(F.min("fragment").alias("fragment"))
    loose = rest.join(first, F.col("path") == F.col("id")).join(known, "fragment").select("key", "decision")
    return exact.unionByName(loose)


def drift(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc, superseded, current, kind) of links (doc, type, key) and decisions (decision, status, superseded_by).

    ``canonical``: a document cites a superseded decision and contradicts the one that took its place; ``cites``: it cites
    a superseded one, whatever took its place.
    """
    links = cut(links.filter("type in ('CITES', 'CONTRADICTS')").distinct())
    named = cut(links.join(resolve_keys(links.select("key"), decisions), "key").select("doc", "type", "decision").distinct())
    old = decisions.filter(F.lower("status") == "superseded").select(F.col("decision").alias("superseded"), F.col("superseded_by").alias("current"))
    cites = named.filter("type = 'CITES'").select("doc", F.col("decision").alias("superseded")).join(old, "superseded")
    against = named.filter("type = 'CONTRADICTS'").select("doc", F.col("decision").alias("current"), F.lit(True).alias("hit"))
    kind = F.when(F.col("hit"), "canonical").otherwise("cites")
    return cites.join(against, ["doc", "current"], "left").select("doc", "superseded", "current", kind.alias("kind"))


def _decisions(spark, sf_dir) -> DataFrame:
    """Parts as decisions: the larger ones are superseded, those of even number by the next."""
    key, old = F.col("p_partkey"), F.col("p_size") > 25
    by = F.when(old & (key % 2 == 0), F.concat(F.lit("DEC-"), key + 1))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("DEC-"), key).alias("decision"), F.when(old, "Superseded").otherwise("accepted").alias("status"), by.alias("superseded_by"))


def _links(spark, sf_dir) -> DataFrame:
    """Lines as links of their orders: by id, by the path of a file, or to something else."""
    part = F.col("l_partkey") + F.when(F.col("l_returnflag") == "A", 1).otherwise(0)
    forms = [F.concat(F.lit("core|dec-"), part), F.concat(F.lit("core|docs/decisions/DEC-"), part, F.lit("-notes.md")), F.concat(F.lit("src/part_"), part, F.lit(".rs"))]
    form = F.element_at(F.array(*forms), (F.pmod(F.col("l_suppkey"), F.lit(3)) + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "R", "CITES").when(F.col("l_returnflag") == "A", "CONTRADICTS").otherwise("MENTIONS")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), kind.alias("type"), form.alias("key"))


def j18(spark, sf_dir):
    return resolve_keys(_links(spark, sf_dir).select("key"), _decisions(spark, sf_dir))


def g21(spark, sf_dir):
    return drift(_links(spark, sf_dir), _decisions(spark, sf_dir))


_D = """with d as (select 'DEC-' || p_partkey decision, lower('DEC-' || p_partkey) f, p_size>25 old, case when p_size>25 and p_partkey%2=0 then 'DEC-' || (p_partkey+1) end superseded_by from part),
l as (select l_orderkey doc, case l_returnflag when 'R' then 'CITES' when 'A' then 'CONTRADICTS' else 'MENTIONS' end as type, case l_suppkey%3 when 0 then 'core|dec-' || p when 1 then 'core|docs/decisions/DEC-' || p || '-notes.md' else 'src/part_' || p || '.rs' end key from (select *, l_partkey + case when l_returnflag='A' then 1 else 0 end p from lineitem)),
k as (select distinct key, lower(case when contains(key,'|') then substr(key, instr(key,'|')+1) else key end) path from l),
g as (select key, path, d.decision from k left join d on d.f=path), c as (select path, min(f) f from (select distinct path from g where decision is null) join d on contains(path, f) group by 1),
r as (select key, decision from g where decision is not null union all select key, d.decision from g join c using(path) join d on d.f=c.f where g.decision is null)"""
ENTRIES = {
    "J18_path_decisions": Entry(j18, _D + " select key, decision from r"),
    "G21_doc_drift": Entry(g21, _D + ", n as (select distinct doc, type, decision from l join r using(key)) select n.doc, n.decision superseded, d.superseded_by as current, case when x.doc is not null then 'canonical' else 'cites' end kind from n join d on d.decision=n.decision and d.old left join n x on x.type='CONTRADICTS' and x.doc=n.doc and x.decision=d.superseded_by where n.type='CITES'"),
}
