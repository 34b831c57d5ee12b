"""Containment joins and drift against nested loops."""

import random

from palimpsest.operators import containment, fulltext


def test_contained_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abcé/", k=rng.choice([0, 1, 3, 12, 60])))) for i in range(120)] + [(500, None), (501, "xyz" * 50)]
    fragments = {"", "a", "zz", "xyzx", "q" * 9, "é/"} | {"".join(rng.choices("abcé/", k=rng.choice([2, 3, 4, 5, 7]))) for _ in range(60)}
    got = containment.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(f,) for f in fragments] + [(None,), ("a",)], "fragment string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f) for i, t in texts for f in fragments if f and t is not None and f in t)
    nothing = spark.createDataFrame([], "fragment string")
    assert containment.contained(spark.createDataFrame(texts, "id long, text string"), nothing).count() == 0


def test_keys_and_drift(spark):
    decisions = spark.createDataFrame([("DEC-1", "Superseded", "DEC-2"), ("DEC-2", "accepted", None), ("DEC-12", "superseded", None), ("DEC-3", "SUPERSEDED", "DEC-2")], "decision string, status string, superseded_by string")
    keys = ["core|dec-12", "DEC-1", "core|docs/DEC-12-x.md", "a|b|dec-2", "core|src/x.rs", None]
    got = containment.resolve_keys(spark.createDataFrame([(k,) for k in keys] * 2, "key string"), decisions)
    # DEC-1 is contained in DEC-12 and comes first; the prefix ends at the first bar
    assert sorted(tuple(r) for r in got.collect()) == [("DEC-1", "DEC-1"), ("a|b|dec-2", "DEC-2"), ("core|dec-12", "DEC-12"), ("core|docs/DEC-12-x.md", "DEC-1")]
    links = [("d1", "CITES", "core|dec-1"), ("d1", "CONTRADICTS", "core|x/dec-2.md"), ("d1", "CITES", "core|dec-12"), ("d2", "CITES", "dec-3"), ("d2", "CITES", "dec-3"), ("d3", "MENTIONS", "dec-3"), ("d4", "CONTRADICTS", "dec-2")]
    found = containment.drift(spark.createDataFrame(links, "doc string, type string, key string"), decisions)
    assert sorted(tuple(r) for r in found.collect()) == [("d1", "DEC-1", "DEC-2", "canonical"), ("d1", "DEC-12", None, "cites"), ("d2", "DEC-3", "DEC-2", "cites")]


def test_passages_as_they_stand(spark):
    docs = [(1, "bathe cat sat on mats"), (2, "the cat  sat on mat"), (3, "The cat sat on mat"), (4, None), (5, "x the cat sat on mat y"), (6, "on")]
    passages = [(1, "the cat sat on mat"), (2, "on"), (3, "cat sat"), (4, None), (5, "sat on")]
    table = spark.createDataFrame(docs, "id long, text string").selectExpr("*", "'' title")
    found = fulltext.containing(fulltext.build(table), table, spark.createDataFrame(passages, "q long, passage string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((q, i) for q, p in passages for i, t in docs if p and t and p in t)


def test_fragments_alike_in_their_grams_meet_only_what_contains_them(spark):
    # every gram of a fragment stands in a tenth of the texts and more
    ids = [f"dec-{i}" for i in range(1000, 1400)]
    texts = spark.createDataFrame([(i, f"docs/{t}-notes.md") for i, t in enumerate(ids)], "id long, text string")
    got = containment.contained(texts, spark.createDataFrame([(t,) for t in ids], "fragment string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan, plan  # compared by equality
    assert sorted(tuple(r) for r in got.collect()) == list(enumerate(ids))
