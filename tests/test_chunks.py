"""Chunks, hashes and states against plain versions on made-up rows."""

from palimpsest.functions import chunks
from palimpsest.operators.windows import alert_states
from palimpsest.streaming.flows import token_bucket


def plain_fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


TEXTS = [None, "", "abc", "Hello", "ÄÖÜ größer €", "x" * 5000, "é" * 3000, "a€" * 1500, "𝄞" * 900]


def test_hashes_and_grams(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: r.h for r in df.select("id", chunks.fnv1a_64(df.text).alias("h")).collect()}
    assert got == {i: None if t is None else f"{plain_fnv(t.encode()):016x}" for i, t in enumerate(TEXTS)}
    weights = {}
    for r in chunks.gram_vectors(df, "id", "text").collect():
        weights.setdefault(r.id, {})[r.bin] = r.weight
    for i, t in enumerate(TEXTS):
        data = "".join(c.lower() if c.isascii() else c for c in t or "").encode()
        want = {}
        for j in range(len(data) - 3):
            b = plain_fnv(data[j : j + 4]) % 256
            want[b] = want.get(b, 0) + 1
        want = want or {0: 1}
        norm = sum(v * v for v in want.values()) ** 0.5
        assert weights[i].keys() == want.keys() and all(abs(weights[i][b] - v / norm) < 1e-12 for b, v in want.items())


def test_byte_windows_cover_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = {}
    for r in chunks.byte_windows(df, "id", "text").orderBy("id", "n").collect():
        found.setdefault(r.id, []).append(r)
    for i, t in enumerate(TEXTS):
        data, w = (t or "").encode(), found.get(i, [])
        assert [r.n for r in w] == list(range(len(w)))
        assert all(r.window.encode() == data[r.first_byte : r.end_byte] and r.end_byte - r.first_byte <= 2048 for r in w)
        assert (w[0].first_byte, w[-1].end_byte) == (0, len(data)) if data else not w
        assert all(0 < b.first_byte - a.first_byte <= 512 and b.first_byte <= a.end_byte for a, b in zip(w, w[1:]))


def test_markdown_sections():
    body = "word " * 60
    text = f"# A\n{body}\n## B\nshort\n### C\n{body}\n```py\n# no heading\n```\n#### D stays\n# E\n```rs x\n" + "line\n" * 41 + f"```\n{body}\n## F\ntail"
    got = list(chunks.sections(text))
    assert [(k, p) for k, p, _ in got] == [("section", "A"), ("section", "A > B > C"), ("section", "E"), ("code", "rs")]
    assert "## B\nshort\n### C" in got[1][2] and "# no heading" in got[1][2] and "#### D stays" in got[1][2]
    assert "[[code-block:0]]\n" in got[2][2] and got[2][2].endswith("## F\ntail") and "line" not in got[2][2]
    assert got[3][2] == "line\n" * 41
    assert list(chunks.sections("")) == [] and list(chunks.sections(" \n")) == []
    assert list(chunks.sections("only text")) == [("section", "", "only text")]
    assert [r[0] for r in chunks.sections("```\nopen\n" + "x\n" * 50)] == ["section", "code"]


def test_markdown_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# T\nsome"), (3, "# T\nsome")], "id long, text string")
    assert [(r.id, r.n, r.path) for r in chunks.markdown_chunks(df, "id", "text").collect()] == [(3, 0, "T")] * 2


def test_mentions_and_headers(spark):
    note = "SESSION :01ARZ3NDEKTSV4RRFFQ69G5FAV [a](src/x) [b](http://h/x.md) `lib/y.py:3` `a b/c.py` DEC-12 DEC-123"
    df = spark.createDataFrame([(note,), (None,), ("",)], "text string")
    got = [[tuple(m) for m in r.m] if r.m is not None else None for r in df.select(chunks.mentions(df.text).alias("m")).collect()]
    assert sorted(got[0]) == [("decision", "DEC-123"), ("path", "lib/y.py:3"), ("path", "src/x"), ("session", "01ARZ3NDEKTSV4RRFFQ69G5FAV")]
    assert got[1] is None and got[2] == []
    head = spark.createDataFrame([("a\n  STATUS: Old \nstatus: new",), ("status:\nstatus: x",), ("\n" * 40 + "status: late",), (None,)], "text string")
    assert [r.s for r in head.select(chunks.header(head.text, "status", 32).alias("s")).collect()] == ["Old", "x", None, None]


def test_alert_states(spark):
    def plain(levels):
        state, bad, good, out = "ok", 0, 0, []
        for x in levels:
            bad, good = (0, good + 1) if x == "ok" else (bad + 1, 0)
            if x == "critical":
                state = "critical"
            elif x == "warn" and bad >= 2 and state != "critical":
                state = "warn"
            elif good >= 5:
                state = "ok"
            out.append(state)
        return out

    import random

    pick = random.Random(5)
    polls = {k: pick.choices(["ok", "warn", "critical"], [6, 3, 1], k=200) for k in range(5)}
    df = spark.createDataFrame([(k, i, x) for k, xs in polls.items() for i, x in enumerate(xs)], "k int, i int, level string")
    got = {(r.k, r.i): r.state for r in alert_states(df, "k", "i", "level").collect()}
    assert got == {(k, i): s for k, xs in polls.items() for i, s in enumerate(plain(xs))}


def test_token_bucket(spark):
    import random

    pick = random.Random(7)
    rows = [(c, t) for c in ("a", "b") for t in sorted(pick.sample(range(60000), 300))] + [("a", 500), ("a", 500), ("c", 1)]
    got = sorted(tuple(r) for r in token_bucket(spark.createDataFrame(rows, "caller string, ms long"), "caller", "ms", 3.0, 2.0).collect())
    want = []
    for c in ("a", "b", "c"):
        left, at = 3.0, None
        for t in sorted(t for k, t in rows if k == c):
            left = min(3.0, left + (t - (t if at is None else at)) / 1000 * 2.0)
            at = t
            want.append((c, t, left >= 1))
            left -= left >= 1
    assert got == sorted(want)


def test_large_ids_beside_nulls(spark):
    df = spark.createDataFrame([(2**53 + 1, "# T\nbody"), (None, "text"), (2**53 + 3, None)], "id long, text string").coalesce(1)
    assert {r.id for r in chunks.byte_windows(df, "id", "text").collect()} == {2**53 + 1, None}
    assert {r.id for r in chunks.markdown_chunks(df, "id", "text").collect()} == {2**53 + 1, None}
