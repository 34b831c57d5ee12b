"""Near-duplicate vectors by product quantisation.

Vectors (scaled to length one, equal ones once) lie in coarse inverted lists; what remains after the list's
centre is coded in subspaces. A vector looks through every list that the list's radii and the plane between the
two centres do not put out of reach, by table lookups that give its distance to every coded vector. As the coding
error of each vector is stored, the lookups are turned into a bound that never drops a pair within reach; what
passes is decided by the exact cosine. Small lists share a block, so that a vector goes once to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, stored, tidied
from .components import components
from .vectors import matrix, packed, parted, sample

#: Rows of a block that are compared at once, and bounds of a block's rows.
PIECE, LEAST_BLOCK, LARGEST_BLOCK = 2048, 2048, 1 << 16


def block_size(total: int) -> int:
    """Rows of a block: about twelve blocks, that is 78 pairs of them.

    A row is sent once for each block it meets, so with a fixed number of blocks what is sent grows with the table, not
    with its square; above 12 * LARGEST_BLOCK rows blocks grow no more, as a task holds two of them.
    """
    return max(LEAST_BLOCK, min(LARGEST_BLOCK, -(-total // 12)))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of a bounded sample, empty ones replaced by drawn points."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        centres[full] = sums / n[full, None]
        if (empty := np.flatnonzero(n == 0)).size:
            centres[empty] = x[rng.choice(len(x), empty.size)]
    return centres


class Quantiser:
    """Coarse centres and one codebook a subspace, fitted on a bounded sample."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256):
        self.centres = kmeans(x, lists, 8, 1)
        dims = x.shape[1]
        self.parts = np.array_split(np.arange(dims), min(subspaces, dims))
        rest = x - self.centres[self.order(x)[:, 0]]
        self.books = [kmeans(rest[:, p], codes, 6, 2) for p in self.parts]

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort((self.centres**2).sum(1)[None] - 2 * x @ self.centres.T, axis=1, kind="stable")

    def code(self, x: np.ndarray, home: np.ndarray):
        """Codes, the part of the distance that depends on the coded vector alone, and the coding error."""
        rest = x - self.centres[home]
        codes = np.stack([((b**2).sum(1)[None] - 2 * rest[:, p] @ b.T).argmin(1) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        near = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, 2 * (self.centres[home] * near).sum(1) + (near**2).sum(1), np.sqrt(((rest - near) ** 2).sum(1))

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of every codeword with every query, subspace by subspace."""
        return [(b @ q[:, p].T).astype(np.float32) for p, b in zip(self.parts, self.books)]


def within(u: np.ndarray, home: np.ndarray, fitted: Quantiser, held: np.ndarray, low: np.ndarray, high: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the ``held`` lists could hold a vector within reach of each u.

    A list's vectors are nearest to its centre, between ``low`` and ``high`` from it; the slack is for rounding.
    """
    centres = fitted.centres[held]
    square = np.maximum(0, (u**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * u @ centres.T)
    own = fitted.centres[home]
    to_own = ((u - own) ** 2).sum(1)
    gap = np.sqrt(np.maximum(0, (own**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * own @ centres.T))
    far = np.sqrt(square)
    bound = np.maximum(far - high, low - far)
    plane = np.where(gap > 1e-4, (square - to_own[:, None]) / (2 * np.maximum(gap, 1e-4)), 0)
    return np.maximum(bound, plane) <= np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6


def links(x: pd.DataFrame, q: pd.DataFrame, fitted: Quantiser, cosine: float, piece: int = PIECE, hold: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in q, in x) of the pairs of one block whose cosine is at least ``cosine``.

    They come some at a time, about ``hold`` or those of ``piece`` rows against ``piece`` rows: so much is held of a block
    of any size, even if all of it is linked.
    """
    home = x["home"].to_numpy()
    order = np.argsort(home, kind="stable")
    lists = [(int(home[at[0]]), at[a : a + piece]) for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) for a in range(0, at.size, piece)]
    qs, xs, n = [], [], 0
    for a in range(0, len(q), piece):
        qv = matrix(q["u"].iloc[a : a + piece])
        tables = fitted.tables(qv)
        for h, at in lists:
            j, i = _list_links(x.iloc[at], qv, tables, fitted, h, cosine)
            qs.append(j + a)
            xs.append(at[i])
            n += i.size
            if n >= hold:
                yield np.concatenate(qs), np.concatenate(xs)
                qs, xs, n = [], [], 0
    if n:
        yield np.concatenate(qs), np.concatenate(xs)


def _list_links(x: pd.DataFrame, qv: np.ndarray, tables: list[np.ndarray], fitted: Quantiser, home: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    xv = matrix(x["u"])
    codes, own, error = matrix(x["codes"], np.uint8), x["own"].to_numpy(), x["error"].to_numpy()
    to_centre = ((qv - fitted.centres[home]) ** 2).sum(1)
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    bound = ((reach + error) ** 2 + 1e-5).astype(np.float32)
    qs, xs = [], []
    for a in range(0, len(x), 256):
        part = slice(a, a + 256)
        dot = tables[0][codes[part, 0]]
        for m in range(1, len(tables)):
            dot += tables[m][codes[part, m]]
        limit = (bound[part] - own[part]).astype(np.float32)
        i, j = np.nonzero(to_centre[None].astype(np.float32) - 2 * dot <= limit[:, None])
        for c in range(0, i.size, 1 << 14):
            ii, jj = i[c : c + (1 << 14)] + a, j[c : c + (1 << 14)]
            near = np.einsum("ij,ij->i", xv[ii], qv[jj]) >= cosine
            xs.append(ii[near])
            qs.append(jj[near])
    return (np.concatenate(qs), np.concatenate(xs)) if qs else (np.empty(0, np.int64), np.empty(0, np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree for each component of the links (a, b): each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, lists: int | None = None, fit_rows: int = 20_000, block_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    n_links: other vectors with a cosine of at least ``cosine``; component_id: the smallest id
    reachable by links. Null, zero and non-finite vectors, and those of another length than most, link with
    nothing. Rows alike in id and vector are one vector, with a row each in the result; an id that stands with
    different vectors is so many vectors of one component, each with its own links. A null id stays alone with a
    null component and is kept. Other columns are ignored, whatever their names; an empty table gives an empty
    result. ``lists`` (a power of two near half the square root of the number of vectors,
    unless given) and codebooks are fitted on at most ``fit_rows`` vectors; every vector is indexed. Blocks of
    ``block_rows`` (see ``block_size`` unless given) meet in one task each.
    """
    spark = vectors.sparkSession
    rows, rest = parted(vectors, id_col, vector_col)

    def scale(batches):
        for b in batches:
            x = matrix(b["v"])
            out = b[["id"]].copy()
            # the largest component first, so that tiny and huge vectors keep their direction
            x = x / np.abs(x).max(1, keepdims=True) if len(b) else x
            out["u"] = [r.tobytes() for r in x / np.sqrt((x**2).sum(1, keepdims=True))] if len(b) else []
            yield out

    scaled = packed(rows).mapInPandas(tidied(scale), "id long, u binary")
    # ``tag`` tells vectors apart whose smallest ids are the same
    groups = stored(scaled.distinct().groupBy("u").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("tag", F.xxhash64("u")), "distinct")
    total = groups.count()
    lists = lists or 1 << max(0, min(10, round(np.log2(max(1.0, total**0.5 / 2)))))
    block_rows = block_rows or block_size(total)
    drawn = sample(groups.select(F.col("u").alias("v")), fit_rows)
    fitted = Quantiser(drawn, lists) if len(drawn) else None

    def place(batches):
        for b in batches:
            out = b.copy()
            if len(b):
                u = matrix(b["u"])
                home = fitted.order(u)[:, 0].astype("<i4")
                codes, own, error = fitted.code(u, home)
                out["home"], out["far"] = home, np.sqrt(((u - fitted.centres[home]) ** 2).sum(1))
                out["codes"], out["own"], out["error"] = [r.tobytes() for r in codes], own, error
            else:
                out = out.assign(home=[], far=[], codes=[], own=[], error=[])
            yield out

    index = stored(groups.mapInPandas(tidied(place), "u binary, id long, n long, tag long, home int, far double, codes binary, own double, error double"), "index")
    # one count and two radii a list come to the driver; neighbouring lists fill a bin up to a block
    files = index.groupBy("home").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("home").collect()
    held, low, high = (np.array([r[c] for r in files], dtype=t) for c, t in (("home", int), ("low", float), ("high", float)))
    bin_of: dict[int, int] = {}
    base_n: dict[int, int] = {}
    for r in files:
        last = len(base_n) - 1
        at = last if last >= 0 and base_n[last] + r["n"] <= block_rows else last + 1
        bin_of[r["home"]], base_n[at] = at, base_n.get(at, 0) + r["n"]

    def look(batches):
        """Bins to look through: a pair in two bins is found from the later one, for both."""
        bins = np.array([bin_of[h] for h in held.tolist()], dtype=int)
        starts = np.flatnonzero(np.diff(bins, prepend=-1))
        for b in batches:
            out = b.copy()
            own, near = np.array([bin_of[h] for h in b["home"].tolist()], dtype=np.int32), []
            u = matrix(b["u"])
            for a in range(0, len(b), 512):
                part = slice(a, a + 512)
                some = np.logical_or.reduceat(within(u[part], b["home"].to_numpy()[part], fitted, held, low, high, cosine), starts, axis=1)
                near += [np.flatnonzero(row[: i + 1]).tolist() for row, i in zip(some, own[part].tolist())]
            yield out.assign(bin=own, near=near)

    index = stored(index.mapInPandas(tidied(look), "u binary, id long, n long, tag long, home int, far double, codes binary, own double, error double, bin int, near array<int>"), "looks")
    query_n = {r[0]: r[1] for r in index.select(F.explode("near").alias("l")).groupBy("l").count().collect()}
    table = lambda n: F.create_map(*[F.lit(x) for i, c in (n or {0: 1}).items() for x in (int(i), -(-c // block_rows))])
    b_blocks, q_blocks = table(base_n), table(query_n)
    left = (
        index.select("u", "id", "n", "tag", "home", "codes", "own", "error", "bin")
        .withColumn("block", F.pmod(F.xxhash64("id"), b_blocks[F.col("bin")]).cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), q_blocks[F.col("bin")] - 1)))
    )
    right = (
        index.select("u", "id", "n", "tag", F.col("bin").alias("own_bin"), F.explode("near").alias("bin"))
        .withColumn("q_block", F.pmod(F.xxhash64("id", F.lit(1)), q_blocks[F.col("bin")]).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), b_blocks[F.col("bin")] - 1)))
    )

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """Links of a block as counts and trees: (id, tag, other, n) with other a node of the same component."""
        empty = pd.DataFrame({"id": [], "tag": [], "other": [], "n": []})
        if not len(x) or not len(q):
            return empty
        found = []
        for j, i in links(x, q, fitted, cosine):
            xi, qi = x["id"].to_numpy()[i], q["id"].to_numpy()[j]
            xt, qt = x["tag"].to_numpy()[i], q["tag"].to_numpy()[j]
            apart = (xi != qi) | (xt != qt)
            i, j, xi, qi, xt, qt = (v[apart] for v in (i, j, xi, qi, xt, qt))
            if not i.size:
                continue
            # each vector counts what it finds; it also counts for a partner in an earlier bin, which does not look here
            back = ~(q["own_bin"] == x["bin"].iloc[0]).to_numpy()[j]
            n = np.concatenate([x["n"].to_numpy()[i], q["n"].to_numpy()[j[back]]])
            counts = pd.DataFrame({"id": np.concatenate([qi, xi[back]]), "tag": np.concatenate([qt, xt[back]]), "n": n}).groupby(["id", "tag"], as_index=False).sum()
            node, root = _forest(xi, qi)
            trees = pd.DataFrame({"id": node, "tag": 0, "other": root, "n": 0})
            found += [counts.assign(other=counts["id"])[["id", "tag", "other", "n"]], trees[trees["id"] != trees["other"]]]
        free_memory()
        return pd.concat(found, ignore_index=True) if found else empty

    keys = ["bin", "block", "q_block"]
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "id long, tag long, other long, n long"), "links")
    linked = found.groupBy("id", "tag").agg(F.sum("n").alias("found"))
    # an id of several vectors makes one component of theirs
    named = scaled.distinct().join(groups.select("u", F.col("id").alias("first")).hint("shuffle_merge"), "u").select("id", "first")
    several = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    shared = named.join(several.hint("shuffle_merge"), "id").filter("id <> first").select("id", F.col("first").alias("other"))
    labels = components(found.filter("id <> other").select("id", "other").unionByName(shared), "id", "other").select(F.col("node").alias("id"), "component")
    per_group = groups.join(linked, ["id", "tag"], "left").join(labels, "id", "left")
    per_group = stored(per_group.select("u", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "groups")
    members = scaled.join(per_group.hint("shuffle_merge"), "u").select("id", "n_links", "component_id")
    alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
