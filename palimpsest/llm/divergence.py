"""How the sources of a language differ in their terms, and the terms that mark each source.

Counts per (lang, source, term) come from one pass over the texts, counted within each batch before anything
moves. Divergences between sources are sparse: every pair starts from the value that all kept terms would give
if neither source held them, and only terms that one or both hold correct it. The leading terms of a source
are found by radix selection: histograms over 16 bits of the value at a time, counted everywhere at once, walk to
each group's threshold, and equal values are then told apart by two bytes of the term at a time.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidied

#: Over UTF-8: all bytes of characters beyond ASCII count, and lower() of bytes changes A-Z alone.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Parts that rows of one group are dealt to where groups are joined, so that a hot one lies in many tasks.
_SALTS = 16


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = 600_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted batch by batch; rows of one key still add up.

    A task holds about ``held`` counts before it hands them on. Nulls are empty texts.
    """
    import pyarrow as pa

    names = ["lang", "source", "term", "n", "docs"]
    text = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)

    def run(batches):
        find = re.compile(TERM).findall
        held_now: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (n, in_docs) in held_now.items():
                terms, times = list(n), list(n.values())
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    group = [pa.repeat(pa.scalar(x.decode()), len(some)) for x in (lang, source)]
                    counts = [pa.array(times[a : a + 50_000], pa.int64()), pa.array(list(map(in_docs.__getitem__, some)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*group, pa.array(some, pa.binary()).cast(pa.string()), *counts], names=names)
            held_now.clear()

        for b in batches:
            for lang, source, whole in zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source", "text"))):
                n, in_docs = held_now.get((lang, source)) or held_now.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                terms = find(whole.lower())
                n.update(terms)
                in_docs.update(set(terms))
                size += len(n) - before
                if size > held:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    return rows.mapInArrow(tidied(run), "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in decimals, as the product passes 64 bits before the counts do."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = (F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", product, (wide(total) + wide(terms)).cast("decimal(38,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(_SALTS)).cast("int")


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], by: str) -> DataFrame:
    """``rows`` with what ``groups`` says of theirs; a group's rows are dealt to many tasks by a hash of ``by``."""
    many = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", _salt(by)).join(many, [*on, "_salt"]).drop("_salt")


def _pair_corrections(terms: DataFrame) -> DataFrame:
    """(g, h, value): for each pair of groups, what terms that both hold add to what either adds alone; sums of batches.

    ``terms``: of, an array of (g, p, p0), a row a term. Pairs are made and added up within a batch, never sent.
    """
    import pyarrow as pa

    def squares(p, q):
        return (p - q) ** 2 // q

    def added(parts):
        g, h, v = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((h, g))
        g, h, v = g[order], h[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])) if g.size else np.empty(0, np.int64)
        return (g[first], h[first], np.add.reduceat(v, first)) if g.size else (g, h, v)

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            lists = b.column("of")
            flat = lists.flatten()
            g, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            n = np.asarray(lists.value_lengths())
            start = np.cumsum(n) - n
            # positions of left members, a bounded number of pairs at a time
            left_n = np.repeat(n, n)
            upto = np.cumsum(left_n)
            a = 0
            while a < g.size:
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 20), side="right")))
                left = np.repeat(np.arange(a, z), left_n[a:z])
                base = np.repeat(np.repeat(start, n)[a:z], left_n[a:z])
                right = base + np.arange(left.size) - np.repeat(upto[a:z] - left_n[a:z] - (upto[a - 1] if a else 0), left_n[a:z])
                apart = left != right
                left, right = left[apart], right[apart]
                v = squares(p[left], p[right]) - squares(p[left], p0[right]) - squares(p0[left], p[right]) + squares(p0[left], p0[right])
                part = added([(g[left], g[right], v)])
                held.append(part)
                size += part[0].size
                a = z
                if size > 1 << 20:
                    held = [added(held)]
                    size = held[0][0].size
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["g", "h", "value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], names=["g", "h", "value"])

    return terms.select("of").mapInArrow(tidied(run), "g long, h long, value long")


def radix_leaders(rows: DataFrame, k: int, by: list[str], item: str = "item", value: str = "value") -> DataFrame:
    """The ``k`` rows of each group with the largest values (0 or more), ties to the item of smaller UTF-8 bytes.

    Items of a group are distinct. ``rows`` should be a stored table: it is read once for each 16 bits of the values
    and for each two bytes by which ties differ. Groups may hold any number of rows; no group is brought together.
    """
    rows = rows.select(*by, item, value)
    # what each group still looks for: ``want`` rows among those that begin with ``prefix``
    state = stored(rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.least("n", F.lit(k)).alias("want"), F.lit(0).cast("long").alias("prefix")), "wanted")

    def chosen(counts: DataFrame, digit: Column) -> DataFrame:
        """The digit at which each group's count reaches ``want``, in the order of ``digit``, and what is wanted there."""
        w = Window.partitionBy(*by).orderBy(digit)
        counts = counts.withColumn("upto", F.sum("c").over(w)).filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
        return counts.withColumn("want", F.col("want") - (F.col("upto") - F.col("c"))).withColumn("settled", F.col("want") == F.col("c"))

    for shift in (48, 32, 16, 0):
        held = _with_groups(rows, state, by, item).filter(F.shiftright(value, min(shift + 16, 63)) == F.col("prefix"))
        digit = F.shiftright(value, shift).bitwiseAND(0xFFFF).alias("digit")
        counts = held.groupBy(*by, digit).agg(F.count("*").alias("c"), F.first("want").alias("want"), F.first("prefix").alias("prefix"))
        found = chosen(counts, F.col("digit").desc())
        state = stored(found.select(*by, "want", (F.shiftleft("prefix", 16) + F.col("digit")).alias("prefix"), "settled"), "wanted")
    limits = state.select(*by, F.col("prefix").alias("limit"), "settled")
    met = _with_groups(rows, limits, by, item)
    over = met.filter((F.col(value) > F.col("limit")) | (F.col("settled") & (F.col(value) == F.col("limit")))).select(*by, item, value)
    # ties at the limit: by the bytes of the item, from the first at which those still in question differ
    raw = F.encode(item, "UTF-8")
    ties = stored(met.filter(~F.col("settled") & (F.col(value) == F.col("limit"))).select(*by, item, value, raw.alias("raw")), "ties")
    state = state.filter(~F.col("settled")).select(*by, "want", F.lit(b"").alias("prefix"))
    parts = [over]
    while not state.isEmpty():
        held = _with_groups(ties, state, by, item).filter(F.col("raw").substr(F.lit(1), F.octet_length("prefix")) == F.col("prefix"))
        ends = held.groupBy(*by).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.first("want").alias("want"))
        ends = stored(ends.select(*by, "want", common_bytes("low", "high").alias("prefix")), "wanted")
        held = _with_groups(ties, ends, by, item).filter(F.col("raw").substr(F.lit(1), F.octet_length("prefix")) == F.col("prefix"))
        after = F.octet_length("prefix")
        counts = held.groupBy(*by, F.col("raw").substr(after + 1, F.lit(2)).alias("digit")).agg(F.count("*").alias("c"), F.first("want").alias("want"), F.first("prefix").alias("prefix"))
        found = stored(chosen(counts, F.col("digit").asc()).select(*by, "want", "settled", "prefix", "digit"), "wanted")
        met = _with_groups(ties, found.withColumnRenamed("prefix", "same"), by, item).filter(F.col("raw").substr(F.lit(1), F.octet_length("same")) == F.col("same"))
        here = F.col("raw").substr(F.octet_length("same") + 1, F.lit(2))
        parts.append(met.filter((here < F.col("digit")) | (F.col("settled") & (here == F.col("digit")))).select(*by, item, value))
        state = found.filter(~F.col("settled")).select(*by, "want", F.concat("prefix", "digit").alias("prefix"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_bytes(a: str, b: str) -> Column:
    """The bytes with which two binary columns begin alike."""

    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            n = min(len(u), len(v))
            differ = np.flatnonzero(np.frombuffer(u, np.uint8, n) != np.frombuffer(v, np.uint8, n))
            out.append(bytes(u[: int(differ[0]) if differ.size else n]))
        return pd.Series(out)

    return F.pandas_udf(alike, "binary")(a, b)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, k: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source of the language, and marking terms.

    A language keeps the terms of at least ``least_docs`` of its documents. Null texts, languages and sources are
    empty strings; every row is a document, repeated ids too. Each (lang, source) that occurs is a group, also
    without terms; where a language keeps none, all its pairs have the value 0. Ties go to the smaller UTF-8 bytes.
    Other columns are ignored, whatever their names; an empty table gives no row. Pairs grow with the square of the
    sources of a language, as the result does.
    """
    counted = term_counts(docs, text_col, lang_col, source_col)
    # one shuffle: rows that lie by (lang, term) also lie by (lang, term, source)
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    kept = stored(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "of"), "terms")
    one = kept.select("lang", "term", "total", F.explode("of").alias("x")).select("lang", "term", "total", "x.source", "x.n")

    text = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct()
    groups = groups.join(one.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v"))).otherwise(F.lit(1).cast("long"))
    groups = stored(groups.select("lang", "source", "v", "lang_n", "group_n", p0.alias("p0"), F.monotonically_increasing_id().alias("g")), "groups")

    cells = _with_groups(one, groups, ["lang", "source"], "term")
    cells = stored(cells.select("lang", "source", "term", "g", "p0", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "cells")

    # pairs: all kept terms at the baseline, corrected where one side holds a term, and where both do
    x, y = groups.select("lang", *[F.col(c).alias(f"x_{c}") for c in ("g", "source", "p0", "v")]), groups.select("lang", *[F.col(c).alias(f"y_{c}") for c in ("g", "source", "p0")])
    pairs = x.join(y, "lang").filter(F.col("x_g") != F.col("y_g"))
    flat = pairs.select(F.col("x_g").alias("g"), F.col("y_g").alias("h"), F.when(F.col("x_v") > 0, F.col("x_v") * excess(F.col("x_p0"), F.col("y_p0"))).otherwise(F.lit(0)).cast("long").alias("value"))
    levels = cells.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("n"))  # terms of a group at each share
    met = levels.join(y, "lang").filter(F.col("g") != F.col("y_g"))
    p, mine, theirs = F.col("p"), F.col("p0"), F.col("y_p0")
    first = F.struct(F.col("g"), F.col("y_g").alias("h"), (F.col("n") * (excess(p, theirs) - excess(mine, theirs))).alias("value"))
    second = F.struct(F.col("y_g").alias("g"), F.col("g").alias("h"), (F.col("n") * (excess(theirs, p) - excess(theirs, mine))).alias("value"))
    single = met.select(F.explode(F.array(first, second)).alias("s")).select("s.*")
    shared = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("of")).filter(F.size("of") > 1)
    value = flat.unionByName(single).unionByName(_pair_corrections(shared)).groupBy("g", "h").agg(F.sum("value").alias("value"))
    named = value.join(groups.select("lang", "source", "g"), "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    pair = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    marking = stored(cells.filter(p > F.col("q")).select("lang", "source", F.col("term").alias("item"), excess(p, F.col("q")).alias("value")), "marking")
    term = radix_leaders(marking, k, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pair.unionByName(term).withColumn("rank", rank)


#: DuckDB: every kept term in every group, every pair over all of them.
AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.group_n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.lang_n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(p.value, 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
