import itertools

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm.language_id")
from palimpsest.llm import language_id, toxicity
from palimpsest.llm.html_text import extract_pages, main_text


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.93
    assert found.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the house of the man is here and there", "the cat and the dog of it"] * 20)]
    rows += [(100 + i, t, "de") for i, t in enumerate(["das haus und der mann ist nicht hier", "die katze und der hund von ihm"] * 20)]
    rows += [(None, None, None), (500, "", None), (501, "12 34 ...", "en"), (502, "das der die " * 5000, None), (502, "das der die " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 lang_pred")
    found = language_id.predict_languages(docs).toPandas()
    assert len(found) == len(rows)
    assert (found[found.doc_id.isna() | found.doc_id.isin([500, 501])].lang_pred == "und").all()
    assert (found[found.doc_id == 502].lang_pred == "de").all()
    nothing = language_id.predict_languages(docs.filter("doc_id >= 500")).toPandas()
    assert set(nothing.lang_pred) <= {"und", "en"}
    assert language_id.predict_languages(docs.limit(0)).count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    lengths = [1, 2, 3, 7, 11, 150, 300]
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    emission, trans = rng.normal(0, 2, sentence.size), rng.normal(0, 1, (2, 2))
    _, forward, backward = toxicity.Chains(sentence).run(emission, trans)
    p = forward * backward / (1 + forward * backward)
    for k, n in enumerate(lengths[:5]):
        e = emission[sentence == k]
        weights = {y: np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weights.values())
        for i in range(n):
            assert p[sentence == k][i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)


def test_toxicity_held_out_and_edges(spark):
    rng = np.random.default_rng(3)
    clean = ["the", "house", "garden", "river", "stone", "walks", "under", "bright", "moon", "slowly"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, 40))
        bad = i % 3 == 0
        if bad:
            words[int(rng.integers(40))] = str(rng.choice(["vilebad", "vileworse", "nastyword"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    rows += [(None, None), (9000, ""), (9001, "a vilebad b"), (9001, "a vilebad b"), (9002, "stone " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 score", "2 toxicity")
    marks = spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, marks).toPandas()
    assert len(found) == len(rows) and found.score.between(0, 1).all()
    truth = dict(labels)
    held = found[found.held_out & found.doc_id.isin(list(truth))]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.98
    spans = found[found.doc_id == 9001].toxic_spans.iloc[0]
    assert [(s["start"], s["end"]) for s in spans] == [(2, 9)]
    assert (found[found.doc_id.isin([9000, 9002])].predicted == 0).all()
    nothing = toxicity.score_toxicity(docs, marks.limit(0)).toPandas()
    assert (nothing.predicted == 0).all()
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=/>Home</a></nav>
<script>var a="<p>no</p>";</script><div class="cookie-notice">We use cookies and the like for it.</div>
<article><h1>Heading</h1><p>The house of the man was old &amp; it stood<br>near the   river for a long time.<p>Ok.
<aside>Other news of the day and more</aside><form><p>Sign up for the news of the day and all</p></form>
<p>And so it was that they went to the town with all of the others.</p></article>
<div id="comments"><p>I think that this is the best of all that I have seen.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Heading\nThe house of the man was old & it stood near the river for a long time.\nOk.\nAnd so it was that they went to the town with all of the others."
    assert main_text("") == "" and main_text("just text &amp; more") == "just text & more"
    assert main_text("<nav><a href=x>Menu</a></nav>") == ""


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", ""), (4, "w", "<p>" + "the word is of it " * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text")
    found = extract_pages(pages).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    assert sorted(r.n_chars for r in found)[:2] == [0, 0]
    assert extract_pages(pages.limit(0)).count() == 0
