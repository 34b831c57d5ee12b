"""Nearest neighbours with a permutation index.

Every vector is represented by the order of all pivots by their distance, and posted in the inverted file of the
nearest one; files lie in blocks of bounded size. A query ranks what is posted by the footrule distance of the orders,
a sum of small integers, and measures the nearest share of all: the footrule distance that this share of a sample of
the table stays within is the query's limit everywhere, so that a block near the query is measured more than one far
from it. The result is what is nearest of the measured.

Equal vectors are indexed once, with their smallest ids: no more of them than a result can hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, packed, sample, usable


def _spread(drawn: np.ndarray, n: int) -> np.ndarray:
    """n of the drawn vectors, each the farthest from those before it: copies of one cluster do not crowd the rest."""
    if not len(drawn):
        return drawn
    taken = [0]
    far = ((drawn - drawn[0]) ** 2).sum(1)
    while len(taken) < min(n, len(drawn)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((drawn - drawn[taken[-1]]) ** 2).sum(1))
    return drawn[taken]


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in the order of distances from each row of x; equal distances by the pivot's number."""
    to = np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1)
    order = np.argsort(to, axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(len(pivots), dtype=np.int16)[None], axis=1)
    return out


def footrule(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Footrule distances of the orders in the rows of q and of x, given as places of the pivots."""
    return np.stack([np.abs(x - row).sum(1, dtype=np.int32) for row in q]) if len(q) else np.empty((0, len(x)), np.int32)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 128, drawn_rows: int = 4096, share: float = 0.12, least: int = 256, block_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest vectors found for each query, by Euclidean distance.

    ``queries`` has the columns of ``vectors``; a query never finds rows of its own id. Null, zero and
    non-finite vectors take no part, neither do null ids; repeated rows count once, and an id that stands with
    different vectors counts with its nearest. Ties go to the smaller id. With fewer candidates all are returned;
    without queries or vectors the result is empty. Other columns are ignored, whatever their names.

    ``pivots`` are chosen spread out from ``drawn_rows`` drawn vectors. All rows are ranked by footrule and about
    ``share`` of them measured for a query, all in tables of up to ``least`` vectors; 1.0 measures everything.
    """
    base = stored(packed(usable(vectors, id_col, vector_col).distinct()), "vectors")
    # equal vectors once: a query needs k of their ids, and one more in case its own is among them
    ranked = base.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    distinct = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    rows = distinct.count()
    sampled = sample(distinct.select("v"), max(drawn_rows, least, k + 2))
    drawn = _spread(sampled, pivots)
    seen = places(sampled, drawn) if len(drawn) else np.empty((0, 0), np.int16)
    within = len(sampled) if share >= 1 else min(len(sampled), max(int(share * len(sampled)), least * len(sampled) // max(rows, 1), k + 2))
    blocks = max(1, -(-rows // block_rows))
    asked = packed(usable(queries, id_col, vector_col, sampled.shape[1]).distinct()).select("id", "v")

    def post(batches):
        for b in batches:
            x = matrix(b["v"])
            at = places(x, drawn) if len(b) else np.empty((0, 0), np.int16)
            # files of neighbouring numbers share a block; one too large for a block is dealt to several by a hash below
            yield b.assign(order=[r.tobytes() for r in at], file=at.argmin(1).astype(np.int32) if len(b) else np.empty(0, np.int32))

    def begin(batches):
        for b in batches:
            at = places(matrix(b["v"]), drawn) if len(b) and len(drawn) else np.empty((len(b), 0), np.int16)
            limits = [int(np.partition(d, within - 1)[within - 1]) for d in footrule(seen, at)] if len(drawn) else [0] * len(b)
            yield b.assign(order=[r.tobytes() for r in at], limit=limits)

    index = stored(distinct.mapInPandas(post, "v binary, ids array<long>, order binary, file int"), "index")
    asked = stored(asked.mapInPandas(begin, "id long, v binary, order binary, limit int"), "queries")

    # at most one count a file comes to the driver
    counts = {r[0]: r[1] for r in index.groupBy("file").count().collect()}
    first, table = 0, []
    for i in sorted(counts):
        table += [F.lit(i), F.struct(F.lit(first // block_rows).alias("at"), F.lit(-(-counts[i] // block_rows)).alias("n"))]
        first += counts[i]
    block = F.create_map(*table)[F.col("file")] if table else F.struct(F.lit(0).alias("at"), F.lit(1).alias("n"))
    posted = index.withColumn("b", block).withColumn("block", (F.col("b.at") + F.pmod(F.xxhash64("v"), F.col("b.n"))).cast("int")).drop("b", "file")
    parts = max(1, -(-asked.count() // block_rows))
    left = posted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))

    def measured(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of a block for each query, of those within the query's limit."""
        found: list[tuple] = []
        if len(x) and len(q):
            xv, qv, ids = matrix(x["v"]), matrix(q["v"]), x["ids"].tolist()
            xo, qo = matrix(x["order"], "<i2"), matrix(q["order"], "<i2")
            for j, (own, limit) in enumerate(zip(q["id"].tolist(), q["limit"].tolist())):
                near = np.flatnonzero(footrule(xo, qo[j : j + 1])[0] <= limit)
                d = np.sqrt(((xv[near] - qv[j]) ** 2).sum(1))
                if d.size > k + 1:
                    best = np.flatnonzero(d <= np.partition(d, k)[k])
                    near, d = near[best], d[best]
                pairs = sorted((s, int(v)) for i, s in zip(near.tolist(), d.tolist()) for v in ids[i] if v != own)
                found += [(own, v, s) for s, v in pairs[:k]]
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(measured, "query_id long, id long, score double")
    # an id whose rows hold different vectors counts with its nearest
    hits = hits.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
