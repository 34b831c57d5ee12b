import collections
import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("palimpsest.llm.near_texts")
from palimpsest.llm import near_texts, near_vectors, nearest, repeats
from palimpsest.llm.components import components


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (7, 7), *((i, i + 1) for i in range(100, 140))]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{i: 100 for i in range(100, 141)}}


def vectors(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[50:80] = x[0] + rng.normal(scale=0.12, size=(30, 16))
    x[80:90] = x[1]
    x[90] = 3 * x[2]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] + [1.0] * 14, 1), (1004, [1.0], 1), (None, x[0].tolist(), 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")


def test_near_vectors_match_brute_force(spark):
    x, df = vectors(spark)
    found = {r.vec_id: r for r in near_vectors.near_duplicates(df).collect() if r.vec_id is not None}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert near.sum() > 100
    for i in range(len(x)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (near[i].sum(), label[i], label[i] == i)
    assert all(found[i].n_links == 0 and found[i].kept for i in (1000, 1001, 1002, 1003, 1004))
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_near_vectors_of_repeated_rows_and_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, a), (5, a), (6, b), (2, c), (6, c), (8, a), (None, a), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 n", "2 tag")
    found = collections.Counter(tuple(r) for r in near_vectors.near_duplicates(df).collect())
    # 6 stands with b, near the vectors of 5 and 8, and with c, that of 2: one component
    assert found == {(5, 2, 2, False): 3, (6, 2, 2, False): 1, (8, 2, 2, False): 1, (2, 1, 2, True): 1, (6, 1, 2, False): 1, (None, 0, None, True): 1, (9, 0, 9, True): 2}


def test_near_vectors_are_whole_in_many_lists(spark):
    # a third of the rows lie in one cluster of mean cosine 0.9, dealt over far more lists than hold most of a vector's pairs
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[:1000] = 3 * rng.normal(size=64) + rng.normal(size=(1000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    found = near_vectors.near_duplicates(df, lists=256, block_rows=512).toPandas().set_index("vec_id").n_links
    assert want.sum() > 100_000
    assert (found.loc[range(len(x))].to_numpy() == want).all(), (found.sum(), want.sum())


def test_nearest_recall_and_edges(spark):
    x, df = vectors(spark, 1, 1500)
    found = nearest.search(df, df.filter("vec_id % 100 = 0")).toPandas()
    hit = 0
    asked = [i for i in range(1500) if i % 100 == 0]
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, d[mine.vec_id], rtol=0, atol=1e-12)
        assert (mine.sort_values(["score", "vec_id"]).vec_id == mine.vec_id).all()
        hit += len(set(want) & set(mine.vec_id))
    assert hit / (10 * len(asked)) >= 0.9
    few = nearest.search(df.filter("vec_id < 3 or vec_id is null"), df.filter("vec_id = 0")).count()
    assert few == 2
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def test_footrule_of_orders():
    rng = np.random.default_rng(2)
    x, q = (np.stack([rng.permutation(12) for _ in range(n)]).astype(np.int16) for n in (20, 7))
    want = [[sum(abs(int(a[p]) - int(b[p])) for p in range(12)) for b in x] for a in q]
    assert nearest.footrule(x, q).tolist() == want
    assert nearest.places(np.array([[0.0], [4.0]]), np.array([[5.0], [1.0], [-1.0]])).tolist() == [[2, 0, 1], [0, 1, 2]]


def test_nearest_of_repeated_rows_and_odd_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(3, [3.0, 1.0]), (3, [100.0, 1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 v", "2 list", "3 score")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (50, [4.0]), (60, [7.0]), (70, None)], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in nearest.search(base, asked, k=3).orderBy("rank").collect()]
    assert found == [(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 3, 4, 3.0)]


def test_nearest_beside_a_hot_cluster(spark):
    # a third of the rows lie in one cluster of mean cosine 0.9
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 64))
    x[:3000] = 3 * rng.normal(size=64) + rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 100 = 0")
    want = {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want[q] = list(np.lexsort((np.arange(len(x)), d))[:10])
    found = nearest.search(df, asked).toPandas()
    hit = {q: len(set(w) & set(found[found.query_id == q].vec_id)) / 10 for q, w in want.items()}
    assert found.groupby("query_id").size().eq(10).all()
    assert np.mean([h for q, h in hit.items() if q < 3000]) >= 0.95 and np.mean([h for q, h in hit.items() if q >= 3000]) >= 0.95
    whole = nearest.search(df, asked.filter("vec_id % 1000 = 0"), share=1.0).toPandas()
    assert all(list(whole[whole.query_id == q].sort_values("rank").vec_id) == want[q] for q in range(0, len(x), 1000))


def test_nearest_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = df.filter("vec_id % 100 = 0")
    some, all_ = (nearest.search(df, asked, share=s).toPandas() for s in (0.12, 1.0))
    pairs = lambda d: set(zip(d.query_id, d.vec_id))
    assert len(all_) and len(pairs(some) & pairs(all_)) >= 0.95 * len(all_)


def near_brute(texts, similarity=0.85):
    seqs = [near_texts.normalised(t or "").split() for t in texts]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if seqs[i] and seqs[j]:
                m = lcs(seqs[i], seqs[j])
                if m >= similarity * (len(seqs[i]) + len(seqs[j]) - m) - 1e-9:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    return label


def test_near_texts_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one two", "ONE  two"]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(6):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                del w[rng.randrange(len(w))]
            texts.append(" ".join(w))
    texts.append("again and " * 4000)
    texts.append("again and " * 4000)
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[5], "c")], "doc_id long, text string, class_id string")
    found = near_texts.near_duplicates(docs).collect()
    assert len(found) == len(texts) + 1
    want = near_brute(texts[:-2]) + [len(texts) - 2] * 2
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == dict(enumerate(want))
    assert all(r.kept == (r.class_id == r.doc_id) for r in found if r.doc_id is not None)
    assert near_texts.near_duplicates(docs.limit(0)).count() == 0


def matches(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for trial in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 25 if trial % 10 else 900))]
        b = a[:]
        for _ in range(rng.randint(0, max(4, len(a) // 6))):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(6)] * rng.randint(0, 2)
            b = b or [0]
        m, x, y = matches(a, b), np.array(a, np.uint64), np.array(b, np.uint64)
        for s in (0.5, 0.8, 0.95):
            assert near_texts.similar(x, y, s, narrow=rng.choice([1, 256])) == (m >= near_texts.needed(len(a), len(b), s))


def test_long_texts_are_aligned_within_the_band():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 5000, 60_000).astype(np.uint64)
    b = np.delete(a, rng.choice(a.size, 40))
    b[rng.choice(b.size, 40)] = 9999
    began = time.perf_counter()
    assert near_texts.similar(a, b, 0.8)
    assert time.perf_counter() - began < 1


def test_words_of_one_hash_are_not_copies(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, f"{x} {x} {x}"), (2, f"{y} {y} {y}")], "doc_id long, text string")
    assert sorted(r.class_id for r in near_texts.near_duplicates(docs).collect()) == [1, 2]


def test_many_rows_of_one_id_and_text(spark):
    text = "the same row again and again as a source may send it"
    rows = [(7, text)] * 10_000 + [(7, "another text of the same id that is not alike"), (3, text.upper()), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = collections.Counter(tuple(r) for r in near_texts.near_duplicates(docs).collect())
    assert found == {(7, 3, False): 10_000, (7, 7, True): 1, (3, 3, True): 1, (None, None, True): 1}


def test_blocks_join_what_representatives_miss(spark):
    # a chain: neighbours are near copies, distant members are not
    rng = random.Random(7)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for k in range(40):
        base = base[:]
        at = rng.randrange(290)
        base[at] = f"new{k}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in near_texts.near_duplicates(docs, block_rows=8).collect()} == {0}


def repeats_brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if n[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1 << 10])
def test_repeats_match_brute_force(spark, shard_bytes, monkeypatch):
    rng = random.Random(5)
    draw = lambda n, alphabet="abcdefghij éß": "".join(rng.choice(alphabet) for _ in range(n))
    passage, line = draw(260), draw(150)
    texts = [None, "", draw(199), "Reat " * 300, "ab" * 500, passage + draw(100), draw(80) + passage, draw(500)]
    texts += [line + draw(120) for _ in range(30)] + [line + "shared tail of some length that is long enough to be found again" + draw(40) for _ in range(4)]
    twin = draw(700)
    texts += [twin, twin, twin[:300] + "X" + twin[300:], draw(3000)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(len(texts), "ab" * 500, 1), (None, draw(300), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    real = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda d, w, g: real(d, w, g, shard_bytes))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats_report(docs).collect()}
    want = repeats_brute([r[1] for r in rows], 200)
    assert found == {r[0]: w for r, w in zip(rows, want)}
    kept = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert kept[0] is None and kept[len(texts) - 1] == texts[-1] and "Reat" not in kept[3]


def test_repeats_of_nothing(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in repeats.repeats_report(docs).collect()} == {(1, 0), (2, 0)}
    assert repeats.repeats_report(docs.limit(0)).count() == 0


def test_repeats_of_many_rows_of_one_id_and_text(spark):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text, tail = draw(300), draw(80)
    rows = [(7, text)] * 10_000 + [(None, text)] * 3 + [(8, text[50:270] + tail), (9, draw(400)), (9, draw(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = collections.Counter(tuple(r) for r in repeats.repeats_report(docs).collect())
    kept = [hashlib.sha256(t.encode()).hexdigest() for t in ("", tail, rows[-2][1], rows[-1][1])]
    assert found == {(7, 300, 300, 1, kept[0]): 10_000, (None, 300, 300, 1, kept[0]): 3, (8, 300, 220, 1, kept[1]): 1, (9, 400, 0, 0, kept[2]): 1, (9, 150, 0, 0, kept[3]): 1}
    left = collections.Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert left == {(7, ""): 10_000, (None, ""): 3, (8, tail): 1, (9, rows[-2][1]): 1, (9, rows[-1][1]): 1}


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for trial in range(40):
        raw = np.frombuffer("".join(rng.choice("ab" if trial % 2 else "abcdefgh") for _ in range(rng.randint(3, 400))).encode() * rng.choice([1, 3]), np.uint8)
        order, b = repeats.suffix_order(raw), raw.tobytes()
        assert [b[p:] for p in order] == sorted(b[p:] for p in range(len(b)))
        for i, k in list(enumerate(repeats.common_prefixes(raw, order, 50)))[1:]:
            x, y = b[order[i] :], b[order[i - 1] :]
            n = 0
            while n < min(50, len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert k == n


def test_windows_of_long_texts_in_stretches():
    rng = np.random.default_rng(3)
    part = bytes(rng.integers(97, 101, 3000).astype(np.uint8))
    texts = [b"short", part + b"x" * 500 + part, b"", part[:250]]
    for width, gram, stretch in ((200, 64, 1000), (50, 16, 333), (200, 64, 200)):
        seen = []
        for size in (1 << 20, stretch):
            text, start, n, low, _ = repeats.windows(texts, width, gram, size)
            strings = [(t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(k)]
            assert len(strings) == len(set(strings)) == sum(max(0, len(t) - width + 1) for t in texts)
            seen.append({(t, s + i): m for t, s, k, m in zip(text.tolist(), start.tolist(), n.tolist(), low.tolist()) for i in range(k)})
        assert seen[0] == seen[1]  # each string has the same minimiser, wherever a stretch begins


def test_windows_of_a_text_of_20_mb_in_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 20_000_000).astype(np.uint8).tobytes()
    tracemalloc.start()
    total = int(repeats.windows([text], 200, 64)[2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(text) - 199 and peak < 500_000_000


@pytest.mark.parametrize("n, replaced", [(25, 2), (100, 8), (100, 7), (300, 24), (100, 5)])
def test_recall_of_sketches_by_similarity(n, replaced):
    # similarity (n - replaced) / (n + replaced): 0.852 to 0.905
    rng = np.random.default_rng(n + replaced)
    met = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[rng.permutation(n)[:replaced]] = rng.integers(0, 1 << 62, replaced).astype(np.uint64)
        met += (near_texts.sketch(near_texts.shingles(a, 5), 24, 2) == near_texts.sketch(near_texts.shingles(b, 5), 24, 2)).any()
    assert met / 400 >= (0.96 if n < 100 else 0.98)


def test_planted_near_copies_are_found(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for k in range(150):
        base = rng.choices(words, k=100)
        near = base[:]
        for at in rng.sample(range(100), 8):
            near[at] = f"new{k}x{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        pairs.append((2 * k, 2 * k + 1))
    classes = {r.doc_id: r.class_id for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(classes[a] == classes[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert len(set(classes.values())) >= 150


def test_near_vectors_send_each_row_to_so_many_blocks_whatever_the_table():
    sizes = [50_000, 100_000, 400_000, 750_000]
    assert all(-(-n // near_vectors.block_size(n)) <= 12 for n in sizes)
    assert near_vectors.block_size(10**9) == near_vectors.LARGEST_BLOCK


def test_near_vectors_links_come_in_pieces():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[100:260] = x[0] + rng.normal(scale=1e-3, size=(160, 8))  # one large group
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    fitted = near_vectors.Quantiser(x, 4)
    home = fitted.order(x)[:, 0]
    codes, own, error = fitted.code(x, home)
    rows = pd.DataFrame({"u": [r.tobytes() for r in x], "home": home, "codes": [r.tobytes() for r in codes], "own": own, "error": error})
    parts = list(near_vectors.links(rows, rows, fitted, 0.9, piece=32, hold=64))
    assert len(parts) > 1 and max(j.size for j, _ in parts) < 64 + 32 * 32
    got = {(a, b) for j, i in parts for a, b in zip(j.tolist(), i.tolist())}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))
