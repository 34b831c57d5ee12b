"""Removal of long repeated strings with suffix arrays.

All strings of ``width`` bytes of a text are laid out in windows that share one minimiser: the smallest hash of
a gram within the string, which depends on the string alone. Equal strings have equal minimisers, so only windows
whose minimiser occurs twice are kept, equal windows once with their number, and those of one minimiser lie in one
shard, or in a few if they are many. Each shard sorts its suffixes (Larsson-Sadakane: groups that are still tied
are refined by the ranks of the suffixes a doubled distance on) and takes common prefixes of neighbours from
text position to text position (Kasai: one position on, a prefix is at most one shorter). Strings that are
single in their shard of a divided minimiser are merged across shards by binary search in sorted runs.

Nothing is sampled or cut short: the minimiser only decides where a string is looked at. Texts that are alike are
one text with its number; if there are several, all of their bytes are repeated, and they only tell about others.

Texts are told apart by 128 bits of their SHA-256. Whether two windows, or two strings of different shards, are equal
is decided by 64-bit hashes of up to 337 bytes: a false match has a chance of about pairs / 2**64, and the known
families of strings that such hashes cannot tell apart are longer than that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, stored, tidied
from .words import _powers, span_hashes

_BLOCK = 1 << 19
#: Marks strings that are known to occur twice within their shard.
_DECIDED = np.uint64(1 << 63)


def _prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Hashes h with h[i] for raw[:i], so that any stretch's hash follows by subtraction."""
    span_hashes(raw[:1].astype(np.uint32), np.array([0]), np.array([1]))
    if _powers[0].size < raw.size + 1:
        span_hashes(raw.astype(np.uint32), np.array([0]), np.array([1]))
    table = (np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
    table ^= table >> np.uint64(29)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(table[raw] * _powers[0][: raw.size], out=sums[1:])
    return sums


def _stretch(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = (sums[last] - sums[first]) * _powers[1][first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def windows(texts: list[bytes], width: int, gram: int, stretch: int = 4 * _BLOCK) -> tuple[np.ndarray, ...]:
    """(text number, start, number of strings, minimiser, content hash) of the windows of some texts.

    Memory goes by ``stretch``, about a hundred bytes for each of its bytes: a longer text is looked at in stretches
    that overlap by one string, so that every string lies in exactly one of them.
    """
    if all(len(t) <= stretch for t in texts):
        return _windows(texts, width, gram)
    found = []
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), stretch):
            some = _windows([text[at : at + stretch + width - 1]], width, gram)
            found.append((some[0] + number, some[1] + at, *some[2:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _windows(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, span = raw.size, width - gram + 1
    if n < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    sums = _prefix_hash(raw)
    at = np.arange(n - gram + 1)
    h = _stretch(sums, at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    keys = (h >> bits << bits) | at.astype(np.uint64)  # the smallest gram, the leftmost on ties
    padded = np.full(-(-keys.size // span) * span, ~np.uint64(0), np.uint64)
    padded[: keys.size] = keys
    tiles = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    low = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & ((np.uint64(1) << bits) - np.uint64(1))
    end = np.cumsum(sizes)
    text = np.searchsorted(end, np.arange(starts), side="right")
    fits = np.arange(starts) + width <= end[np.minimum(text, sizes.size - 1)]
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    stop = fits & np.append(new[1:] | ~fits[1:], True)
    last = np.flatnonzero(stop)
    return text[first], first - (end - sizes)[text[first]], last - first + 1, h[low[first].astype(np.int64)], _stretch(sums, first, last + width)


def suffix_order(raw: np.ndarray) -> np.ndarray:
    """Positions of ``raw`` in the order of its suffixes."""
    n = raw.size
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n + 1, np.int64)
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(head, place, 0))
    rank[order] = first
    rank[n] = -1
    h = 8
    while h < n:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not slots.size:
            break
        group = order[slots]
        key2 = rank[group] * (n + 2) + rank[np.minimum(group + h, n)] + 1
        by = np.argsort(key2, kind="stable")
        group, key2 = group[by], key2[by]
        order[slots] = group
        head[slots] = np.concatenate([[True], key2[1:] != key2[:-1]])
        first = np.maximum.accumulate(np.where(head, place, 0))
        rank[group] = first[slots]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, limit: int, stride: int = 16) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it (0 for the first), up to ``limit``.

    Every ``stride``-th text position is compared from its start; those between begin where the position
    before them lets them: a prefix loses at most one byte a step.
    """
    n = raw.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    member = np.zeros(n + 1, dtype=bool)
    member[order] = True
    padded = np.concatenate([raw, np.zeros(limit + 16, np.uint8)])
    words = np.zeros(n + limit + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + words.size].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)

    def extend(p: np.ndarray, got: np.ndarray) -> None:
        q = before[p]
        p, q, got = p[q >= 0], q[q >= 0], got[q >= 0]
        while p.size:
            x = words[p + got] ^ words[q + got]
            same = x == 0
            tail = np.zeros(p.size, np.int64)
            if not same.all():
                low = x & (~x + np.uint64(1))
                tail = np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            got = got + np.where(same, 8, tail)
            # a suffix ends with the text
            got = np.minimum(got, np.minimum(limit, n - np.maximum(p, q)))
            out[p] = got
            go = same & (got < limit) & (np.maximum(p, q) + got < n)
            p, q, got = p[go], q[go], got[go]

    base = np.flatnonzero(member[:n])
    sampled = base[::stride]
    extend(sampled, np.zeros(sampled.size, np.int64))
    for k in range(1, stride):
        p = base[k::stride]
        left = base[k - 1 :: stride][: p.size]
        near = (p - left == 1) & (before[left] >= 0) & member[before[left] + 1]  # what follows must be there to compare with
        extend(p, np.where(near, np.maximum(out[left] - 1, 0), 0))
    return out[order]


def repeated_in(contents: list[bytes], times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of all contents, in order: content number, offset, and whether it occurs twice."""
    raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes - width + 1
    of = np.repeat(np.arange(sizes.size), n)
    offset = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
    position = begin[of] + offset
    number = np.full(raw.size, -1, np.int64)
    number[position] = np.arange(of.size)
    order = suffix_order(raw)
    order = order[number[order] >= 0]  # suffixes that start a string; those in the tails served the ranks
    same = common_prefixes(raw, order, width) >= width
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weights=times[of[number[order]]])
    twice = np.empty(of.size, dtype=bool)
    twice[number[order]] = total[group] >= 2
    return of, offset, twice


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).tolist()


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, m, n_bytes, raw): each different text of (k1, k2, text) that holds a string, its number, compressed."""
    one = docs.filter(F.octet_length("text") >= width).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("m"))

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "m": b["m"], "n_bytes": [len(r) for r in raw], "raw": [pack(r) for r in raw]})

    return stored(one.mapInPandas(tidied(run), "k1 long, k2 long, m long, n_bytes long, raw binary"), "texts")


def _packed_windows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            k1, k2, m, sizes = (b[c].to_numpy() for c in ("k1", "k2", "m", "n_bytes"))
            a = 0
            while a < len(b):
                z, size = a, 0
                while z < len(b) and (z == a or size + sizes[z] <= _BLOCK):
                    size += sizes[z]
                    z += 1
                text, start, n, low, content = windows([unpack(r) for r in b["raw"].iloc[a:z]], width, gram)
                yield pd.DataFrame({"k1": k1[a:z][text], "k2": k2[a:z][text], "m": m[a:z][text], "start": start.astype(np.int32), "n": n.astype(np.int16), "low": low.view(np.int64), "content": content.view(np.int64)})
                a = z

    return texts.select("k1", "k2", "m", "n_bytes", "raw").mapInPandas(tidied(run), "k1 long, k2 long, m long, start int, n short, low long, content long")


def repeated_spans(texts: DataFrame, width: int = 200, gram: int = 64, shard_bytes: int = 1 << 20) -> DataFrame:
    """(k1, k2, spans) for the single texts of ``_texts`` that hold a repeated string.

    spans: byte intervals (from, to) covered by strings of ``width`` bytes that start anywhere else too.
    """
    spark = texts.sparkSession
    every = _packed_windows(texts, width, gram)
    again = stored(every.select("low").groupBy("low").agg(F.count("*").alias("times")).filter("times > 1").select("low"), "minimisers")
    found = stored(every.join(again.hint("shuffle_merge"), "low"), "windows")
    contents = found.groupBy("low", "content", "n").agg(F.sum("m").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("at"))
    contents = stored(contents.select("low", "content", "n", "times", "at.*"), "contents")

    # a minimiser with very many different windows is divided
    row_bytes = F.col("n") + F.lit(width)
    sizes = contents.groupBy("low").agg(F.sum(row_bytes).alias("bytes")).filter(F.col("bytes") > shard_bytes // 4)
    sizes = stored(sizes.select("low", F.ceil(F.col("bytes") / (shard_bytes // 4)).cast("int").alias("parts")), "sizes")
    total = contents.agg(F.sum(row_bytes)).first()[0] or 0
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    wanted = contents.join(sizes.hint("shuffle_merge"), "low", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "content", "n", "times", "start", "parts", "part")).alias("some"))

    def fetched(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        columns = ["low", "content", "n", "times", "parts", "part", "bytes"]
        for b in batches:
            rows, size = [], 0
            for raw, some in zip(b["raw"], b["some"]):
                text = unpack(raw)
                for r in some:
                    rows.append((r["low"], r["content"], r["n"], r["times"], r["parts"], r["part"], text[r["start"] : r["start"] + r["n"] + width - 1]))
                    size += r["n"] + width
                    if size > 8 * _BLOCK:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    shipped = texts.select("k1", "k2", "raw").join(by_text.hint("shuffle_merge"), ["k1", "k2"]).select("raw", "some")
    shipped = shipped.mapInPandas(tidied(fetched), "low long, content long, n short, times long, parts int, part int, bytes binary")
    sharded = shipped.withColumn("shard", F.when(F.col("parts") > 1, F.xxhash64("low", "part")).otherwise(F.pmod(F.xxhash64("low"), F.lit(shards))))

    def sort_shard(x: pd.DataFrame) -> pd.DataFrame:
        """Runs of repeated strings of each content; for divided minimisers also the hashes of all, sorted."""
        data = [bytes(v) for v in x["bytes"]]
        # a shard may hold many minimisers: some at a time bounds the memory
        x = x.reset_index(drop=True)
        low = x["low"].to_numpy()
        order = np.argsort(low, kind="stable")
        size = np.cumsum([len(data[i]) for i in order])
        cut = np.concatenate([[True], low[order][1:] != low[order][:-1]])
        batch = (size - 1) // shard_bytes
        batch = np.maximum.accumulate(np.where(cut, batch, 0))
        out = []
        for g in np.unique(batch):
            rows = order[batch == g]
            of, offset, twice = repeated_in([data[i] for i in rows], x["times"].to_numpy()[rows], width)
            edge = np.searchsorted(of, np.arange(rows.size + 1))
            for j, i in enumerate(rows.tolist()):
                flags = twice[edge[j] : edge[j + 1]]
                hashes = None
                if x["parts"].iat[i] > 1:  # other shards ask for these strings too
                    sums, at = _prefix_hash(np.frombuffer(data[i], np.uint8)), np.arange(flags.size)
                    hashes = np.stack([_stretch(sums, at, at + width), at.astype(np.uint64) | np.where(flags, _DECIDED, np.uint64(0))], axis=1)
                    hashes = hashes[np.argsort(hashes[:, 0], kind="stable")].tobytes()
                out.append((low[i], x["content"].iat[i], x["n"].iat[i], x["part"].iat[i], _runs(flags), hashes))
        free_memory()
        return pd.DataFrame(out, columns=["low", "content", "n", "part", "runs", "hashes"])

    judged = stored(sharded.groupBy("shard").applyInPandas(sort_shard, "low long, content long, n short, part int, runs array<array<int>>, hashes binary"), "judged")
    runs = judged.filter(F.size("runs") > 0).select("low", "content", "n", "runs")

    # across the shards of a divided minimiser: runs of hashes by range, so that no group outgrows a task
    def ranged(batches):
        for b in batches:
            rows = []
            for low, content, n, part, hashes, ranges in zip(b["low"], b["content"], b["n"], b["part"], b["hashes"], b["ranges"]):
                a = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
                r = (a[:, 0] >> np.uint64(40)).astype(np.int64) * int(ranges) >> 24
                for k in np.unique(r).tolist():
                    rows.append((low, k, content, n, part, a[r == k].tobytes()))
            yield pd.DataFrame(rows, columns=["low", "range", "content", "n", "part", "hashes"])

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        """Strings of one range that stand in another shard too: found by binary search in its sorted run."""
        x = x.reset_index(drop=True)
        a = [np.frombuffer(v, np.uint64).reshape(-1, 2) for v in x["hashes"]]
        row = np.repeat(np.arange(len(a)), [len(v) for v in a])
        both = np.concatenate(a)
        part = x["part"].to_numpy()[row]
        sorted_runs = {p: np.sort(both[part == p, 0]) for p in np.unique(part).tolist()}
        hit = np.zeros(len(both), dtype=bool)
        for p, run in sorted_runs.items():
            other = np.flatnonzero((part != p) & ~hit & ((both[:, 1] & _DECIDED) == 0))
            at = np.minimum(np.searchsorted(run, both[other, 0]), run.size - 1)
            hit[other] |= run[at] == both[other, 0]
        out = []
        for i in np.unique(row[hit]).tolist():
            flags = np.zeros(int(x["n"].iat[i]), dtype=bool)
            flags[both[hit & (row == i), 1].astype(np.int64)] = True
            out.append((x["low"].iat[i], x["content"].iat[i], x["n"].iat[i], _runs(flags)))
        free_memory()
        return pd.DataFrame(out, columns=["low", "content", "n", "runs"])

    pending = judged.filter("hashes is not null").select(F.col("low").alias("low"), F.col("content").alias("content"), F.col("n").alias("n"), F.col("part").alias("part"), F.col("hashes").alias("hashes"))
    pending = pending.join(sizes.hint("shuffle_merge"), "low").withColumn("ranges", F.col("parts")).drop("parts")
    ranges = pending.mapInPandas(tidied(ranged), "low long, range int, content long, n short, part int, hashes binary")
    crossed = ranges.groupBy("low", "range").applyInPandas(merge, "low long, content long, n short, runs array<array<int>>")
    runs = stored(runs.unionByName(crossed), "runs")

    where = found.filter("m = 1").join(runs.hint("shuffle_merge"), ["low", "content", "n"])
    spans = F.transform("runs", lambda r: F.struct((F.col("start") + r[0]).alias("from"), (F.col("start") + r[1] + width).alias("to")))
    return where.select("k1", "k2", spans.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_bytes(text: bytes, spans) -> tuple[bytes, int, int]:
    """What remains of a text, the bytes removed and the number of maximal removed runs."""
    merged: list[list[int]] = []
    for a, z in sorted((s["from"], s["to"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    parts, at = [], 0
    for a, z in merged:
        parts.append(text[at:a])
        at = z
    parts.append(text[at:])
    return b"".join(parts), sum(z - a for a, z in merged), len(merged)


def _keyed(docs: DataFrame, text_col: str, names: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """``docs`` with two numbers that identify the text: 128 bits of its SHA-256."""
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.withColumns({k: F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for k, at in zip(names, (1, 17))})


def _cut(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) for the different texts of (k1, k2, text) that lose bytes."""
    texts = _texts(docs, width)
    spans = stored(repeated_spans(texts, width, gram), "spans")

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = [kept_bytes(unpack(raw), s) for raw, s in zip(b["raw"], b["spans"])]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows], "kept": [r[0] for r in rows]})

    single = texts.select("k1", "k2", "raw").join(spans.hint("shuffle_merge"), ["k1", "k2"])
    single = single.select("k1", "k2", "raw", "spans").mapInPandas(tidied(cut), "k1 long, k2 long, n_removed long, n_spans long, kept binary")
    # all of a text that is there again is repeated
    copies = texts.filter("m > 1").select("k1", "k2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return single.unionByName(copies)


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every byte gone that a repeated string of ``width`` bytes covers.

    Texts are judged whole and as given, all copies lose the string. A character that is cut in two is left out
    whole. Null texts stay null; rows, also repeated ones and those with null ids, are all kept. Other columns pass
    untouched, whatever their names but _k1, _k2 and _new; an empty table stays empty.
    """
    keyed = _keyed(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text")
    changed = stored(_cut(keyed, width, gram).select("k1", "k2", "kept"), "changed")

    def readable(batches):
        for b in batches:
            yield pd.DataFrame({"_k1": b["k1"], "_k2": b["k2"], "_new": [bytes(x).decode("utf-8", "ignore") for x in b["kept"]]})

    new = changed.mapInPandas(tidied(readable), "_k1 long, _k2 long, _new string")
    own = _keyed(docs, text_col, ("_k1", "_k2"))
    joined = own.join(new.hint("shuffle_merge"), ["_k1", "_k2"], "left")
    return joined.select(*[F.coalesce("_new", F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def repeats_report(docs: DataFrame, width: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row; null texts count as empty.

    Texts are judged whole; repeated rows, and rows with a null id, are occurrences like any other and have a row
    each. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text")
    changed = _cut(keyed.select("k1", "k2", "text"), width, gram)

    def digest(batches):
        for b in batches:
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "n_removed": b["n_removed"], "n_spans": b["n_spans"], "sha": [hashlib.sha256(x).hexdigest() for x in b["kept"]]})

    cut = stored(changed.mapInPandas(tidied(digest), "k1 long, k2 long, n_removed long, n_spans long, sha string"), "cut")
    whole = keyed.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return whole.join(cut.hint("shuffle_merge"), ["k1", "k2"], "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
