"""What one task holds does not grow with the table, and pairs of intervals are met once."""

import itertools
import random

from palimpsest.operators import graph, joins, temporal
from palimpsest.sources import shared


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def largest(df):
    return max(df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect())


def test_spread_grows_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    assert [shared.spread(spark.range(n), n, "id").rdd.getNumPartitions() for n in (10, 1000, 4000)] == [4, 10, 40]


def test_votes_and_ancestors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 50)
    line = spark.range(1, 1001).selectExpr("id node", "id - 1 parent")
    found = temporal.ancestry(line, 3)
    assert found.count() == sum(min(v, 8) for v in range(1, 1001)) and largest(found) < 500
    edges = spark.range(1000).selectExpr("id src", "id + 1 dst", "id % 3 + 1 weight")
    labels = graph.propagate_labels(edges, 1)
    want = {v: max(((w + 1, -o) for w, o in (((v - 1) % 3, v - 1), (v % 3, v + 1)) if 0 <= o <= 1000)) for v in range(1001)}
    assert dict(rows(labels)) == {v: -o for v, (_, o) in want.items()}
    assert len(labels.inputFiles()) >= 20
    assert rows(graph.propagate_labels(edges.limit(1), 0)) == [(0, 0), (1, 1)]
    assert rows(graph.propagate_labels(edges.limit(0))) == []


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(7)
    some = [(i, rng.randrange(2), s := rng.randrange(60), s + rng.choice((0, 1, 2, 9, 10, 11, 40))) for i in range(70)]
    want = sorted((x[0], y[0]) for x, y in itertools.permutations(some, 2) if x[0] > y[0] and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    df = spark.createDataFrame(some, "id long, grp int, s long, e long")
    for width in (1, 10, 1000):
        assert rows(joins.overlapping(df, df, "grp", "s", "e", width).select("a_id", "b_id")) == want
    # one long interval over many bins meets another long one in a single bin: no pair is made again and dropped
    long_ = spark.createDataFrame([(1, 0, 0, 5000), (2, 0, 1, 5000)], "id long, grp int, s long, e long")
    plan = joins.overlapping(long_, long_, "grp", "s", "e", 1)
    assert rows(plan.select("a_id", "b_id")) == [(2, 1)] and "greatest(FLOOR" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
