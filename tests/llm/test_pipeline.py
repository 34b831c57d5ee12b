import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("palimpsest.llm")
from test_pairs import near_brute, repeats_brute


def test_stages_keep_what_they_should(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "repeats", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out = out.cache()
        assert 0 < out.count() <= before
        if name == "near_duplicates":
            assert out.select("text").distinct().count() == out.count() < before
        docs, before = out, out.count()
    pieces = corpus_pipeline.packing(spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before


def test_near_duplicates_keep_one_row_of_each_class(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(5))
    rows = [(7, a), (7, a), (None, b), (None, b), (None, c), (3, c), (5, d), (9, d + " more"), (9, e), (11, None), (11, None), (12, " "), (12, " "), (-4, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    want = [(-4, a), (None, b), (3, c), (5, d), (9, e), (11, None), (11, None), (12, " "), (12, " ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_run_against_plain_python(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    english = "the of and house garden river stone walks under bright moon slowly to in is was that it for on with".split()
    german = "der die und haus garten fluss stein geht unter hell mond langsam zu den von das mit sich des auf".split()
    draw = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    passage = draw(english, 80)
    texts, toxic = [], set()
    for i in range(240):
        words = draw(german if i % 3 == 0 else english, rng.randint(20, 90)).split()
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vilebad", "vileworse", "nastyword"])
            toxic.add(i)
        if i % 20 == 1 and i % 3:  # in one language
            words[5:5] = passage.split()
        texts.append(" ".join(words) + ".")
    for i in (1, 2, 3, 5):  # copies and near copies
        toxic |= {len(texts), len(texts) + 1} if i in toxic else set()
        texts += [texts[i].upper() + " ", texts[i] + " " + rng.choice(english)]
    rows = list(enumerate(texts))
    clean = [r for r in rows if r[0] not in toxic]
    odd = [(None, texts[1]), (None, draw(german, 40)), (900, texts[2]), (900, draw(english, 50)), (901, texts[7]), (901, texts[7]), (902, None), (903, ""), (904, "12 34 ... 56"), (905, " \n")]
    docs = spark.createDataFrame([(i, t, None if t is None or not t.strip() else "de" if t.lower().split()[0] in german else "en", "s", len(t or "")) for i, t in rows + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    # plainly: rows of letters that are not toxic, the first of each class, without what stands twice
    kept = sorted(clean + [r for r in odd if r[1] and any(c.isalpha() for c in r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first: dict[int, tuple] = {}
    for row, label in zip(kept, near_brute([t for _, t in kept])):
        first.setdefault(label, row)
    kept = list(first.values())
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for (i, t), left in zip(kept, _left([t for _, t in kept])):
        want.append((-1 if i is None else i, np.array([*library.encode(left, add_special_tokens=False).ids, 1], "<u4")))
    ids = lambda column: [-1 if np.isnan(i) else int(i) for i in column.astype(float)]
    assert sorted(set(ids(found.doc_id))) == sorted({i for i, _ in want})
    assert found.length.sum() == sum(x.size for _, x in want)
    assert {i for i, x in want if x.size > 60} and (found.groupby("sequence_id").length.sum() <= 2048).all()
    crc = {(i, x[a:z].size, zlib.crc32(x[a:z].tobytes())) for i, x in want for r in found.itertuples() if r.doc_tokens == x.size for a, z in [(r.start, r.start + r.length)]}
    assert set(zip(ids(found.doc_id), found.length, found.ids_crc32)) <= crc


def _left(texts):
    """What the 200-byte rule leaves, plainly."""
    raw = [t.encode() for t in texts]
    n: dict[bytes, int] = {}
    for b in raw:
        for p in range(len(b) - 199):
            n[b[p : p + 200]] = n.get(b[p : p + 200], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    assert [len(b) - r[1] for b, r in zip(raw, repeats_brute(texts, 200))] == [len(t.encode()) for t in out]
    return out
