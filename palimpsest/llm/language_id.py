"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits; for each bit a binary classifier over byte n-grams (naive
Bayes weights, calibrated by a logistic curve) predicts it. A text gets the language whose codeword has the
smallest weighted logistic loss against the predicted bits; nearly tied codewords are flagged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty, with_text_columns
from .words import blocks

_ORDERS, _BITS = (2, 3, 4), 16
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of lower-case text: letters and all bytes beyond ASCII stay, anything else is a space.
_MAP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: every split of up to five languages, else 31 drawn columns that tell all apart."""
    if n <= 5:
        cols = [[1 if (c | 1 << (n - 1)) >> (n - 1 - i) & 1 else -1 for i in range(n)] for c in range((1 << (n - 1)) - 1)] or [[1] * n]
        return np.array(cols, dtype=np.int8).T
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, max(31, 2 * n)))
        code = code[:, np.abs(code.sum(0)) < n]
        d = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if d > apart:
            best, apart = code, d
    return best


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-gram numbers at each byte for each order; where each text starts and ends."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = _MAP[np.frombuffer(b"    ".join(raw) + b"        ", dtype=np.uint8)].astype(np.uint32)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    starts = np.cumsum(sizes + 4) - sizes - 4
    out, h = [], joined.copy()
    for k in range(1, max(_ORDERS)):
        h = h[:-1] * np.uint32(0x01000193) ^ joined[k:]
        if k + 1 in _ORDERS:
            x = h * np.uint32(0x9E3779B1)
            out.append((x >> np.uint32(32 - _BITS)).astype(np.int64))
    return out, starts, starts + sizes


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # orders, n-grams, bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # of each bit, from its accuracy on texts not used for its weights

    def margins(self, texts: list[str]) -> np.ndarray:
        """The mean weight of the n-grams of each text, for each bit."""
        out = np.empty((len(texts), self.code.shape[1]))
        for a, z in blocks(texts):
            grams, starts, ends = _grams(texts[a:z])
            total = self.weights[0][grams[0][: ends[-1]]]
            for w, g in zip(self.weights[1:], grams[1:]):
                total += w[g[: ends[-1]]]
            edges = np.stack([starts, ends], axis=1).ravel()[:-1]
            out[a:z] = np.add.reduceat(total, edges, axis=0)[::2] / (ends - starts)[:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the two nearest codewords are nearly tied."""
        n = len(texts)
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
        z = np.clip(self.margins(texts) * self.slope + self.offset, -30, 30)
        loss = np.stack([(np.logaddexp(0, -c * z) * self.trust).sum(1) for c in self.code], axis=1)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        share = near / near.sum(1, keepdims=True)
        top = share.argmax(1)
        score = share.max(1)
        letters = np.array([bool(_LETTER.search(t)) for t in texts])
        lang = [self.languages[k] if ok else "und" for k, ok in zip(top, letters)]
        second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(n)
        return lang, np.where(letters, score, 0.0), ~letters | (second > 0.8 * score)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins m and labels y (0/1), by Newton steps."""
    scale = np.abs(m).mean() or 1.0
    x = np.stack([m / scale, np.ones_like(m)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (text, language) pairs; every third text of a language calibrates the bits."""
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages)) if languages else np.ones((0, 1), dtype=np.int8)
    size = 1 << _BITS
    counts = np.zeros((len(languages), len(_ORDERS), size))
    kept: list[tuple[str, int]] = []
    seen = [0] * len(languages)
    for k, lang in enumerate(languages):
        texts = [t for t, x in rows if x == lang]
        part = [t for i, t in enumerate(texts) if i % 3 or len(texts) < 3]
        kept += [(t, k) for i, t in enumerate(texts) if not i % 3]
        seen[k] = len(part)
        for a, z in blocks(part):
            grams, starts, ends = _grams(part[a:z])
            inside = np.zeros(ends[-1], dtype=bool)
            for s, e in zip(starts, ends):
                inside[s:e] = True
            for o, g in enumerate(grams):
                counts[k, o] += np.bincount(g[: ends[-1]][inside], minlength=size)
    rate = counts / np.maximum(counts.sum(2, keepdims=True), 1)  # each language weighs the same
    weights = np.zeros((len(_ORDERS), size, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        yes, no = (rate[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.full(rate.shape[1:] or (len(_ORDERS), size), 1 / size) for s in (1, -1))
        weights[:, :, b] = np.log(yes + 0.05 / size) - np.log(no + 0.05 / size)
    n = code.shape[1]
    model = LanguageModel(languages, code, weights, np.ones(n), np.zeros(n), np.ones(n))
    if len(languages) > 1 and kept:
        m = model.margins([t for t, _ in kept])
        truth = np.array([k for _, k in kept])
        for b in range(n):
            y = (code[truth, b] == 1).astype(float)
            model.slope[b], model.offset[b] = _logistic(m[:, b], y)
            right = ((m[:, b] * model.slope[b] + model.offset[b] > 0) == (y == 1)).mean()
            model.trust[b] = max(0.05, 2 * right - 1)
        model.trust /= model.trust.mean()
    return model


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_chars: int) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language outside the held-out fold, drawn by a hash of the id."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & (F.length(text_col) <= max_chars))
    n = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not n:
        return []
    part = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, per_language / k))])
    drawn = (F.xxhash64(F.col(id_col).cast("string")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    return sorted((r[0], r[1]) for r in rows.filter(drawn < part[F.col(lang_col)]).select(text_col, lang_col).collect())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score and lang_ambiguous.

    Null texts and texts without a letter: ``und``, score 0, ambiguous. Repeated rows and null ids are
    scored like any other. Columns of these names that ``docs`` has are replaced.
    """
    return with_text_columns(docs, text_col, [("lang_pred", "string"), ("lang_score", "double"), ("lang_ambiguous", "boolean")], lambda: model.predict)


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, max_chars: int = 50_000) -> LanguageModel:
    """Fit on a bounded sample: ``per_language`` texts of at most ``max_chars`` characters a language."""
    return fit(training_rows(docs, id_col, text_col, lang_col, per_language, max_chars))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for each row, learned from the rows not held out.

    Null texts and texts without a letter are ``und`` with score 0. Texts are scored whole, however long, each on its
    own: repeated rows and null ids like any other. Of languages tied for the first place the first in order is taken,
    and the row is ambiguous. Other columns are ignored, whatever their names; an empty table gives an empty result,
    and without labelled rows every text is ``und``.
    """
    model = learn_languages(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text"), held_out(id_col).alias("held_out"))
    found = identify(rows, model, "_text")
    return found.select(id_col, "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
