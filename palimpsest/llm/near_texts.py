"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its words, sampled by its five-word shingles. Each of several sketches takes, under its
own hash, the few smallest occurrence-labelled shingles and keeps them in text order, so that texts agree in a
sketch if they share these shingles in this order, which texts of few edits do. Texts that agree are candidates;
two are linked if an alignment of their words within the band that the threshold allows matches enough of them:
matched / (all of both - matched) >= similarity.

Copies (equal up to case and white space) are one text throughout. Of a bucket of texts that agree, all are aligned
with two representatives first. Those that remain in different components are then compared with the rest of
their bucket in blocks, where shared words are counted by a matrix product and only pairs that could reach
the threshold are aligned. No bucket is cut short and no pairs are listed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, stored, tidied
from .components import components
from .words import WordNumbers, blocks, code_points, runs

_SPACES = re.compile(r"\s+")


def normalised(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip()


class WordHashes:
    """64-bit hashes of the words of normalised texts; each distinct word is hashed once a task."""

    def __init__(self):
        self.numbering = WordNumbers(self._learn, self._forget)

    def _forget(self) -> None:
        self.values = np.empty(0, np.uint64)

    def _learn(self, words: list[str]) -> None:
        raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)
        self.values = np.concatenate([self.values, np.frombuffer(raw, np.uint64)])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, z in blocks(texts):
            joined = "\n".join(texts[a:z]) + "\n"
            cp = code_points(joined)
            first, last = runs((cp != 32) & (cp != 10))
            number = self.numbering.numbers(joined, cp, first, last)
            h = self.values[number]
            ends = np.cumsum([len(t) + 1 for t in texts[a:z]])
            out += np.split(h, np.searchsorted(first, ends[:-1]))
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of a sequence of words in order; one of all words if there are fewer."""
    n = max(0, words.size - size) + 1
    h = words[:n]
    for k in range(1, min(size, words.size)):
        h = _mix(h) + words[k : k + n]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of a shingle apart."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    at = np.arange(s.size)
    nth = np.empty(s.size, np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return h ^ (nth * np.uint64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray, sketches: int, kept: int) -> np.ndarray:
    """One 64-bit key a sketch: its ``kept`` smallest labelled shingles, hashed in text order."""
    x = labelled(h)
    k = min(kept, x.size)
    out = np.empty(sketches, np.uint64)
    step = max(1, (1 << 18) // x.size)
    for a in range(0, sketches, step):
        s = np.arange(a, min(a + step, sketches), dtype=np.uint64)[:, None]
        v = x[None] * (2 * s + np.uint64(0x5851F42D4C957F2D)) + s * np.uint64(0x14057B7EF767814F)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        at = np.sort(np.argpartition(v, k - 1, axis=1)[:, :k], axis=1)
        key = _mix(s[:, 0] + np.uint64(1))
        for i in range(k):
            key = _mix(key + x[at[:, i]])
        out[a : a + step] = key
    return out


def needed(a: int, b: int, similarity: float) -> int:
    """Fewest matches between sequences of these lengths that reach the threshold."""
    return int(np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sequences share, in whatever order."""
    return np.intersect1d(labelled(a), labelled(b), assume_unique=True).size if a.size and b.size else 0


def _matched(a: list[int], b: list[int], ahead: int, behind: int) -> int:
    """Most matches of an alignment that pairs a[i] with b[j] only where -behind <= i - j <= ahead, or a little beyond.

    A row of the alignment is a whole number whose bits are positions of ``a``, zero where a match ends. Only
    those within the band are held, for as many columns at a time as the band is wide; bits that have left it
    are final, and those it has not reached are still ones.
    """
    wide = max(256, ahead + behind + 1)
    start, row, done = 0, 0, 0
    stop = 0
    for c in range(0, len(b), wide):
        s, e = min(len(a), max(start, c - behind)), max(stop, min(len(a), c + wide + ahead))
        gone = s - start
        done += gone - (row & ((1 << gone) - 1)).bit_count()
        row = row >> gone | ((1 << (e - stop)) - 1) << (stop - s) if stop >= s else (1 << (e - s)) - 1
        done -= max(0, s - stop)
        start, stop = s, e
        at: dict[int, int] = {}
        for i, x in enumerate(a[s:e]):
            at[x] = at.get(x, 0) | 1 << i
        full = (1 << (e - s)) - 1
        for x in b[c : c + wide]:
            m = at.get(x)
            if m:
                u = row & m
                row = ((row + u) | (row - u)) & full
    return done + (stop - start) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float, narrow: int = 256) -> bool:
    """Whether the best alignment of two sequences reaches the threshold.

    Cells further off the diagonal than the threshold lets elements go unmatched lie on no alignment good
    enough; a narrow band is tried first, as few edits stay within it.
    """
    if a.size > b.size:
        a, b = b, a
    need = needed(a.size, b.size, similarity)
    if need > a.size or not a.size:
        return False
    # equal ends are part of a best alignment
    differ = np.flatnonzero(a != b[: a.size])
    head = int(differ[0]) if differ.size else a.size
    differ = np.flatnonzero(a[head:][::-1] != b[head:][::-1][: a.size - head])
    tail = int(differ[0]) if differ.size else a.size - head
    if head + tail >= need:
        return True
    need -= head + tail
    a, b = a[head : a.size - tail], b[head : b.size - tail]
    if _common(a, b) < need:
        return False
    ahead, behind = a.size - need, b.size - need
    x, y = a.tolist(), b.tolist()
    if ahead + behind > 2 * narrow + b.size - a.size and _matched(x, y, min(ahead, narrow), min(behind, narrow + b.size - a.size)) >= need:
        return True
    return _matched(x, y, ahead, behind) >= need


def _block_links(left: pd.DataFrame, right: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions in left and right) between texts of different components, enough to join these."""
    ls, rs = ([np.frombuffer(x, np.uint64) for x in d["seq"]] for d in (left, right))
    lx, rx = np.concatenate([labelled(x) for x in ls]), np.concatenate([labelled(x) for x in rs])
    shared = np.intersect1d(lx, rx)
    l_n, r_n = np.array([x.size for x in ls]), np.array([x.size for x in rs])
    l_row, r_row = np.repeat(np.arange(len(ls)), l_n), np.repeat(np.arange(len(rs)), r_n)
    common = np.zeros((len(ls), len(rs)), np.float32)
    for a in range(0, shared.size, 4096):
        part = shared[a : a + 4096]
        sides = []
        for x, row, n in ((lx, l_row, len(ls)), (rx, r_row, len(rs))):
            at = np.minimum(np.searchsorted(part, x), part.size - 1)
            hit = part[at] == x
            m = np.zeros((n, part.size), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    need = np.ceil(similarity / (1 + similarity) * (l_n[:, None] + r_n[None]) - 1e-9)
    l_label, r_label = left["label"].tolist(), right["label"].tolist()
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out_l, out_r = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(common >= need))):
        a, b = find(l_label[i]), find(r_label[j])
        if a != b and similar(ls[i], rs[j], similarity):
            root[a] = b
            out_l.append(i)
            out_r.append(j)
    return np.array(out_l, dtype=int), np.array(out_r, dtype=int)


def near_duplicates(docs: DataFrame, similarity: float = 0.85, words: int = 5, sketches: int = 24, kept: int = 2, block_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) for each row of ``docs``.

    class_id: the smallest id reachable by copies and links; kept: true for one row of each class, that with
    this id. Null and empty texts, and texts of white space, are duplicates of nothing. Texts of fewer than
    ``words`` words are one shingle; long ones are sketched and aligned whole. Rows with a null id are kept,
    class_id null; rows that repeat an id and are not null are told apart by their text, and those alike in both
    are all kept or all dropped. Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    rows = rows.withColumn("own", F.xxhash64("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketched(batches):
        hashes = WordHashes()
        for b in batches:
            texts = [normalised(t) if isinstance(t, str) else "" for t in b["text"]]
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] if t else None for t in texts]
            distinct = {d: t for d, t in zip(digest, texts) if d}
            keys = {d: sketch(shingles(w, words), sketches, kept).view(np.int64).tolist() for d, w in zip(distinct, hashes.of(list(distinct.values())))}
            yield pd.DataFrame({"id": b["id"], "own": b["own"], "node": digest, "keys": [keys.get(d) for d in digest]})

    each = stored(rows.select("id", "own", "text").mapInPandas(tidied(sketched), f"id {id_type}, own long, node binary, keys array<long>"), "sketches")
    some = each.filter("node is not null")
    texts = some.groupBy("node").agg(F.min(F.struct("id", "own")).alias("at"), F.first("keys").alias("keys"))
    texts = stored(texts.select("node", "at.id", "at.own", "keys"), "texts", each.count(), 50_000)
    n_texts = texts.count()
    n_keys = n_texts * sketches
    keyed = texts.select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("one"), F.max(F.struct(F.xxhash64("node").alias("h"), "node")).alias("two")).filter("n > 1")
    buckets = stored(buckets.select("key", "n", F.col("one.node").alias("one"), F.col("two.node").alias("two")), "buckets", n_keys)
    members = stored(keyed.join(buckets.hint("shuffle_merge"), "key"), "members", n_keys)

    # every text against the representatives of its buckets: extremes of one order, so that buckets share them
    pairs = members.select("node", F.explode(F.array("one", "two")).alias("with")).filter(F.col("node") != F.col("with"))
    pairs = pairs.select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()
    pairs = stored(pairs, "pairs", 2 * n_keys)
    wanted = members.select("node").distinct().join(texts.select("node", "id", "own"), "node")
    # one row of each text, found by its id and text; an inner join, as rows alike in both may be many
    source = rows.join(wanted.hint("shuffle_merge"), ["id", "own"]).select("node", "text")

    def sequenced(batches):
        hashes = WordHashes()
        for b in batches:
            texts = {bytes(n): normalised(t) for n, t in zip(b["node"], b["text"])}
            texts = {n: t for n, t in texts.items() if hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] == n}
            yield pd.DataFrame({"node": list(texts), "seq": [w.tobytes() for w in hashes.of(list(texts.values()))]})

    sequences = stored(source.mapInPandas(tidied(sequenced), "node binary, seq binary").dropDuplicates(["node"]), "sequences", n_texts, 20_000)
    seq = lambda c, s: sequences.select(F.col("node").alias(c), F.col("seq").alias(s))
    both = pairs.join(seq("a", "x").hint("shuffle_merge"), "a").join(seq("b", "y").hint("shuffle_merge"), "b")

    def verified(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b["x"], b["y"])]
            yield b[ok][["a", "b"]]

    links = stored(both.select("a", "b", "x", "y").mapInPandas(tidied(verified), "a binary, b binary"), "verified", 2 * n_keys)
    labels = components(links, rows=2 * n_keys)

    # what no representative decided: members of a bucket, other than its representatives, in several components
    rest = members.filter((F.col("node") != F.col("one")) & (F.col("node") != F.col("two"))).select("key", "node")
    rest = rest.join(labels.hint("shuffle_merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    sizes = rest.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    open_keys = stored(open_keys.select("key", "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("apart")), "open", n_keys)
    opened = stored(rest.join(open_keys.hint("shuffle_merge"), "key"), "opened", n_keys)
    opened = opened.join(seq("node", "seq").hint("shuffle_merge"), "node")
    blocks_of = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), blocks_of(c) - 1))
    own = [F.col(c).alias(c) for c in ("key", "node", "label", "seq")]  # new columns, as both sides come from one table
    left = opened.filter("label <> main").select(*own, F.pmod(F.xxhash64("node"), blocks_of("apart")).cast("int").alias("l_block"), upto("n").alias("r_block"))
    right = opened.select(*own, upto("apart").alias("l_block"), F.pmod(F.xxhash64("node"), blocks_of("n")).cast("int").alias("r_block"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        i, j = _block_links(x, y, similarity)
        free_memory()
        return pd.DataFrame({"a": x["node"].to_numpy()[i], "b": y["node"].to_numpy()[j]})

    by = ["key", "l_block", "r_block"]
    more = stored(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "a binary, b binary"), "more", n_keys)
    labels = components(links.unionByName(more).filter("a <> b"), rows=2 * n_keys)

    named = texts.select("node", F.col("id").alias("first")).join(labels.hint("shuffle_merge"), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named", n_texts)
    lowest = named.groupBy("component").agg(F.min("first").alias("class_id"))
    classes = stored(named.join(lowest.hint("shuffle_merge"), "component").select("node", "class_id"), "classes", n_texts)
    found = each.filter("node is not null").select("id", "node").join(classes.hint("shuffle_merge"), "node").select("id", "class_id")
    alone = each.filter("node is null").select("id", F.col("id").alias("class_id"))
    nulls = docs.filter(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"))
    return found.unionByName(alone).unionByName(nulls).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
