"""Rows that meet themselves are joined once, in one order, and their pairs turned."""

import itertools
import random

from palimpsest.operators import joins


def test_pairs_of_the_same_rows_meet_in_one_join(spark):
    rng = random.Random(11)
    some = [(rng.randrange(90), rng.randrange(2), s := rng.randrange(40), s + rng.choice((-1, 0, 1, 2, 9, 30)), rng.choice("xyz") if i else None) for i in range(120)]
    some.append((None, 0, 0, 40, "x"))
    df = spark.createDataFrame(some, "id long, grp int, s long, e long, kind string")
    fine = [x for x in some if x[0] is not None]
    pairs = [(x, y) for x, y in itertools.permutations(fine, 2) if x[0] > y[0] and x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
    flat = lambda found: sorted(str((*x, *y)) for x, y in found)
    for width in (1, 7, 1000):
        every = joins.overlapping(df, df, "grp", "s", "e", width)
        assert sorted(str(tuple(r)) for r in every.collect()) == flat(pairs)
        assert sum("Join" in line for line in every._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
        other = joins.overlapping(df, df, "grp", "s", "e", width, "kind")
        unlike = [(x, y) for x, y in pairs if None not in (x[4], y[4]) and x[4] != y[4]]
        assert sorted(str(tuple(r)) for r in other.collect()) == flat(unlike)
        two = joins.overlapping(df, df.filter("id < 40"), "grp", "s", "e", width, "kind")
        assert sorted(str(tuple(r)) for r in two.collect()) == flat((x, y) for x, y in unlike if y[0] < 40)
