import zlib

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm.token_counts")
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm.packing import Windows, WordEncoder, pack
from palimpsest.llm.pieces import Encoder, decode_ids, decode_texts, encode_texts, round_trip, viterbi, vocabulary
from palimpsest.llm.token_counts import count_tokens

TEXTS = [None, "", "The house.", "It's a DON'T  test", "<|endoftext|> a", "naïve café 12345 ½ ²³ a_b", "日本語 á x", "word " * 5000, "The house.", " \n\t "]


def twins(n):
    """The Thue-Morse word of n letters and its complement: polynomial hashes modulo a power of two take them for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SCHEMA = "doc_id long, text string, n_tokens string, start string"


def rows(texts):
    return [(None if i == 4 else i, t, "x", "y") for i, t in enumerate(texts)]


def test_counts_are_those_of_the_library(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.createDataFrame(rows(TEXTS), SCHEMA)
    cache_path = str(tmp_path / "cache")
    found = count_tokens(docs, path, cache_path=cache_path).collect()
    want = sorted((len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in (t or "" for t in TEXTS))
    assert sorted((r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    cache = spark.read.parquet(cache_path)
    assert cache.count() == len({t or "" for t in TEXTS})  # copies are encoded once
    assert sorted((r.n_bytes, r.n_tokens) for r in count_tokens(docs, path, cache_path=cache_path).collect()) == want
    assert spark.read.parquet(cache_path).count() == len({t or "" for t in TEXTS})  # a second run encodes nothing
    more = spark.createDataFrame(rows(TEXTS + ["one more"]), SCHEMA)
    assert count_tokens(more, path, cache_path=cache_path).count() == len(TEXTS) + 1
    assert spark.read.parquet(cache_path).count() == len({t or "" for t in TEXTS}) + 1  # and one new text one
    again = count_tokens(more, path, cache=cache).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in again) == sorted(want + [(8, len(lib.encode("one more").ids))])
    assert count_tokens(docs.limit(0), path).count() == 0


def test_counts_of_long_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \t" * 600_000 + "b", "x" * 1_000_000]
    found = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert found == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_word_ids_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), [t or "" for t in TEXTS]
    for t, ids in zip(texts, WordEncoder(path).encode(texts, 1)):
        assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]


def test_packing_holds_each_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA).coalesce(1)
    found = pack(docs, path, size=256).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = found[found.doc_id == i].sort_values("start")
        assert (mine.doc_tokens == ids.size).all() and mine.length.sum() == ids.size
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for _, seq in found.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all()
        total = int(seq.length.sum())
        assert total == 256 or total & (total - 1) == 0
    assert pack(docs.limit(0), path).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    w = Windows(64, 0)
    for i in range(400):
        n, size = w.count.copy(), int(rng.integers(1, 64))
        options = []
        for level in [0, *np.flatnonzero(n)]:
            if level + size <= 64:
                after = n.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 64
                options.append((after[1:64] ** 2).sum())
        w.place((i, 0, np.zeros(size, np.uint32), size))
        assert (w.count[1:64] ** 2).sum() == min(options)


def test_pieces_are_those_of_the_library_and_come_back(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in TEXTS] + ["banana" * 60, " " * 50, "x" + " " * 37 + "y", "aaaa" * 90, "({[);\r\n\t=x", "é \U0001f600 \x00 z"]
    v = vocabulary(path)
    for t, ids in zip(texts, Encoder(path).encode(texts)):
        assert ids.tolist() == sp.encode(t)
        assert decode_ids(v, ids) == t
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, *texts])], "doc_id long, text string, ids int")
    back = decode_texts(encode_texts(docs, path), path).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert all(r.exact for r in round_trip(docs, path).collect())
    assert round_trip(docs.limit(0), path).count() == 0


def test_unigram_search_is_the_best_path():
    class Toy:
        merges, longest, byte, unknown = False, 4, {}, 0
        score = {"a": -3.0, "b": -3.0, "ab": -4.0, "aba": -4.5, "ba": -5.0, "bab": -4.0}
        id = {p: i + 1 for i, p in enumerate(score)}

        def fallback(self, char):
            return [0]

    toy = Toy()
    names = {i: p for p, i in toy.id.items()}

    def best(t):
        top = {0: (0.0, [])}
        for j in range(1, len(t) + 1):
            top[j] = max((top[i][0] + toy.score[t[i:j]], [*top[i][1], t[i:j]]) for i in range(max(0, j - 4), j) if t[i:j] in toy.score)
        return top[len(t)]

    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        t = "".join(rng.choice(["a", "b"], n))
        got = [names[i] for i in viterbi(toy, t)]
        assert "".join(got) == t and abs(sum(toy.score[p] for p in got) - best(t)[0]) < 1e-9


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_one_hash_are_told_apart(n):
    import sentencepiece

    from palimpsest.llm.words import WordNumbers, code_points, span_hashes

    x, y = twins(n)
    cp = code_points(x + " " + y)
    h = span_hashes(cp, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert h[0] == h[1]
    learned = []
    numbering = WordNumbers(learned.extend, learned.clear)
    for text in (f"{x} {y} {x}", f"{y} {y} {x}", f"{y} z {x}"):
        cp = code_points(text)
        first = np.array([0, *(i + 1 for i, c in enumerate(text) if c == " ")])
        last = np.array([*(i for i, c in enumerate(text) if c == " "), len(text)])
        assert [learned[k] for k in numbering.numbers(text, cp, first, last)] == text.split(" ")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for t, ids in zip((x, y), WordEncoder(path).encode([x, y], 1)):
        assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for t, ids in zip((x, y), Encoder(path).encode([x, y])):
        assert ids.tolist() == sp.encode(t)


def test_large_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(2**53 + 1, "some words"), (None, "other words"), (2**53 + 3, None)], "doc_id long, text string").coalesce(1)
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in got.collect()} == {2**53 + 1, None, 2**53 + 3}
    named = docs.selectExpr("concat('d', doc_id) doc_id", "text")
    assert {r.doc_id for r in pack(named, public_tokenizers.path("word_bpe_49k.json")).collect()} == {f"d{2**53 + 1}", None, f"d{2**53 + 3}"}
