"""Quality, conversation repair and source divergence against plain versions, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm.quality")
from palimpsest.llm import conversations, divergence, quality
from palimpsest.llm.common import stored


# conversations


def plain_repair(rows):
    """rows: (turn, role, text) in order. Every edit string of up to n + 4 labels is tried, cheapest first."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(conversations.WHITE)
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    best = None
    todo = [(0, 0, "", ())]
    while todo:
        i, cost, audit, done = todo.pop()
        if best and cost > best[0]:
            continue
        grow = "".join(r[:1] or "?" for r, _ in done)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", grow):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, done)
        if not re.fullmatch("(s?(ua)*u?)?", grow):
            continue
        if audit[-2:] != "II":
            todo += [(i, cost + 3, audit + "I", (*done, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            todo.append((i + 1, cost + 4, audit + "D", done))
            if faults[i] in (0, 3):
                more = 3 if faults[i] else 0
                todo += [(i + 1, cost + 3 + more, audit + "R", (*done, (r, text))) for r in ("user", "assistant")]
                todo.append((i + 1, cost + more, audit + "K", (*done, (role, text))))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = ["".join(r[1][:1] for r in p) for p in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(text.encode()).hexdigest()


def test_repair_against_every_edit(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        mine = []
        for turn in range(rng.choice([0, 1, 2, 3, 4, 5])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                mine.append((turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "so", " \t", "", "What?  ", "end \x0b", "ñ…", "B."])))
        if conv % 7 == 0:
            mine = [(None, r, t) for _, r, t in mine]
        want[conv] = plain_repair(sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        rows += [(conv, *r) for r in mine]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 audit", "2 cost")
    found = conversations.repair_report(turns, ids=spark.range(60).withColumnRenamed("id", "conv_id"), held=64)
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == want
    # the rows themselves give the digest
    texts = collections.defaultdict(list)
    for r in sorted(conversations.repair(turns, held=16).collect(), key=lambda r: (r.conv_id, r.step)):
        if r.edit != "D":
            texts[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == row[-1]


def test_damage_and_nulls(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None), (None, None, None, None), (3, None, None, "x" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.Counter(tuple(r) for r in conversations.damaged(turns).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want[c, t, "user" if k == 4 else role, text] += 0 if k == 0 else 2 if k == 3 else 1
    assert got == +want
    report = {r.conv_id: r for r in conversations.repair_report(turns).collect()}
    assert (report[None].blank, report[None].gaps, report[None].audit, report[None].cost) == (2, 0, "DD", 8)
    assert conversations.repair_report(turns.limit(0), ids=turns.limit(0)).count() == 0


def test_long_conversation_is_read_in_order(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("7 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('Turn ', id, '.') text")
    row = conversations.repair_report(turns, held=1 << 10).collect()[0]
    assert (row.gaps, row.cost, row.audit) == (0, 0, "K" * n)
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Turn {i}." for i in range(n)).encode()).hexdigest()


# divergence


def plain_audit(rows, k):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, l, s in rows if l == lang]
        docs = collections.Counter(w for _, ws in mine for w in set(ws))
        kept = {w for w in docs if docs[w] >= 3}
        by = {s: collections.Counter() for s, _ in mine}
        for s, ws in mine:
            by[s].update(w for w in ws if w in kept)
        whole = sum(by.values(), collections.Counter())

        def shares(c):
            return {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in by if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (v, w) in enumerate(found) if part == "pair" or i < k]
    return sorted(out)


def test_divergence_against_every_term(spark):
    rng = random.Random(3)
    words = ["the", "The", "Éa", "éa", "ÑANDÚ", "x" * 300, "x" * 300 + "y", "x" * 300 + "z", "文字", "😀", "a'b", "c7d", "q"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 3, 40]))), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "", None, "ü"])) for _ in range(150)]
    rows += [("solo", "xx", "one"), ("duo", "xx", "two"), (None, "xx", None), ("the " * 50_000, "en", "a")] * 1
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 term", "2 value").repartition(5)
    for k in (200, 4, 1):
        assert sorted(tuple(r) for r in divergence.audit(docs, k=k).collect()) == plain_audit(rows, k)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_are_handed_on_in_parts(spark):
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(j, j + 50)), "en", "s") for j in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    one, many = (divergence.term_counts(docs, held=h).groupBy("term").agg({"n": "sum", "docs": "sum"}).collect() for h in (1 << 20, 60))
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_leaders_with_ties(spark, k):
    rng = random.Random(k)
    rows = {(g, "p" * rng.choice([0, 40]) + "".join(rng.choices("abé", k=rng.choice([0, 1, 2, 7])))): rng.choice([0, 5, 5, 5, 70_000, 1 << 33, (1 << 59) + 3]) for g in ("x", "y") for _ in range(400)}
    table = stored(spark.createDataFrame([(g, i, v) for (g, i), v in rows.items()], "g string, item string, value long"), "rows")
    want = [r for g in ("x", "y") for r in sorted(((g, i, v) for (h, i), v in rows.items() if h == g), key=lambda r: (-r[2], r[1].encode()))[:k]]
    assert sorted(tuple(r) for r in divergence.radix_leaders(table, k, ["g"]).collect()) == sorted(want)


# quality


def test_gradients():
    rng = np.random.default_rng(1)
    model = quality.QualityModel.begin(2, 5, 4, 3)
    for name in ("embed", "filters", "bias", "hidden", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.bias = rng.normal(0, 0.1, 5)  # away from the bend at 0, where an empty text would lie
    raws = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 3, 200, 700)] + [b"one one one one one one " * 20]
    codes, n = quality.laid_out(raws)
    y = np.array([1, 0, 1, 0, 0])
    grads, _ = model.step(codes, n, y)
    for name, g in zip(("embed", "filters", "bias", "hidden", "out"), grads):
        w = getattr(model, name)
        for at in rng.permutation(w.size)[:25]:
            i = np.unravel_index(at, w.shape)
            if name == "embed" and i[0] == quality.NONE:
                continue
            loss = []
            for by in (1e-3, -1e-3):
                v = w.copy()
                v[i] += by
                setattr(model, name, v)
                p = model.combine(model.halves(codes).astype(np.float64), n)[-1]
                loss.append(-np.log(np.where(y == 1, p, 1 - p)).mean())
            setattr(model, name, w)
            assert g[i] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-3), (name, i)


def test_chunks_cover_whole_texts():
    model = quality.QualityModel.begin(4, 6, 5, 2)
    rng = np.random.default_rng(0)
    texts = ["", "a", "é" * 500, "".join(map(chr, rng.integers(97, 123, 70_000))), "same words " * 3000]
    together = model.scores(texts)
    assert together == pytest.approx([model.scores([t])[0] for t in texts], abs=1e-6)
    # every byte is seen by the filters: plain loops over all places
    raw = texts[3].encode()[:1000]
    codes, _ = quality.laid_out([raw])
    echo = [float(any(raw[i : i + 4] == raw[i - g : i - g + 4] for g in range(1, 33) if i >= g)) if len(raw) - i >= 4 else 0.0 for i in range(len(raw))]
    assert quality.echoes(codes)[32 : 32 + len(raw) - 4].tolist() == echo[:-4]
    top = model.halves(codes)
    x = np.concatenate([model.embed[codes], quality.echoes(codes)[:, None]], axis=1)
    y = np.array([(x[i : i + 8].ravel() @ model.filters) for i in range(len(top) * 128)])
    assert top == pytest.approx(y.reshape(len(top), 128, -1).max(1), abs=1e-4)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = quality.score_quality(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert found.score.between(0, 1).all()
    assert (found.predicted == found.quality).mean() > 0.97
    assert found[found.quality == 1].predicted.mean() > 0.98
    assert found[found.quality == 0].predicted.mean() < 0.12


def test_quality_edges(spark):
    rows = [(i, t) for i, t in enumerate(["good words of many kinds", "bad!!! bad!!! bad!!!"] * 30)] + [(None, None), (900, ""), (901, "long text " * 40_000), (901, "long text " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 score", "2 quality")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    found = quality.score_quality(docs, labels).toPandas()
    assert len(found) == len(rows) and found.score.between(0, 1).all()
    assert found[found.doc_id == 901].score.nunique() == 1
    assert found[found.doc_id.isna() | (found.doc_id == 900)].score.nunique() == 1
    one = quality.score_quality(docs, labels.filter("quality = 1")).toPandas()
    assert one.score.nunique() == 1 and one.predicted.eq(1).all()
    none = quality.score_quality(docs, labels.limit(0)).toPandas()
    assert none.score.eq(0.5).all()
    assert quality.score_quality(docs.limit(0), labels).count() == 0
