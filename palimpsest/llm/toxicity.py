"""Toxic spans by a linear-chain conditional random field, and scores of whole documents.

A sentence is a chain of word tokens labelled clean or toxic. Emission weights belong to the word itself, its
prefixes and its suffixes; transition weights to neighbouring labels. Token labels for training come from
document labels: in toxic documents, a token is toxic if one of its features occurs in many toxic and hardly
any clean training documents. Forward-backward marginals give offending offsets and, through a logistic
curve over their largest value, sum and share, the score of the document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty, with_text_columns
from .words import DIGIT, LETTER, WordNumbers, blocks, code_points, kinds, runs

_BITS = 18
#: Characters that end a sentence.
_STOPS = np.array([ord(c) for c in "\n.!?。！？"], dtype=np.uint32)


def features(word: str) -> list[str]:
    """The word, its prefixes of 4 to 8 characters and its suffixes of 4 and 5."""
    n = len(word)
    return ["=" + word, *("<" + word[:k] for k in range(4, min(n, 8) + 1)), *(">" + word[-k:] for k in range(4, min(n, 5) + 1))]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - _BITS)


class Tokens:
    """The tokens of texts: numbers of distinct words, offsets, the text and the sentence each is of."""

    def __init__(self, learn, forget):
        self.numbering = WordNumbers(learn, forget)

    def of(self, texts: list[str]):
        # lower-casing must keep offsets
        lower = [low if len(low := t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
        joined = "\n".join(lower) + "\n"
        cp = code_points(joined)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        kind = kinds()[np.minimum(cp, 0xFFFF)]
        first, last = runs((kind == LETTER) | (kind == DIGIT))
        words = self.numbering.numbers(joined, cp, first, last)
        text_of = np.searchsorted(starts, first, side="right") - 1
        stops = np.flatnonzero(np.isin(cp, _STOPS))
        sentence = np.searchsorted(stops, first)
        return words, first - starts[text_of], last - starts[text_of], text_of, sentence


#: Tokens of a segment: longer chains are cut, and what a segment does to the odds is composed first.
_SEGMENT = 64


class Chains:
    """Sentences side by side, so that each step of the recursions serves many at once.

    A chain's recursions on odds are compositions of maps o -> (a o + b) / (c o + d). Chains are cut into
    segments of at most 64 tokens; maps of inner segments are composed for all at once, applied along each
    long chain, and the segments then run side by side from the right odds. Nothing is approximated.
    """

    def __init__(self, sentence: np.ndarray):
        edge = np.flatnonzero(np.diff(sentence, prepend=-1)) if sentence.size else np.empty(0, np.int64)
        length = np.diff(np.append(edge, sentence.size))
        pieces = -(-length // _SEGMENT)
        chain = np.repeat(np.arange(edge.size), pieces)
        self.depth = np.arange(chain.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = edge[chain] + self.depth * _SEGMENT
        self.length = np.minimum(_SEGMENT, edge[chain] + length[chain] - self.start)
        self.after = pieces[chain] - 1 - self.depth  # segments that follow in the chain
        self.size = sentence.size

    def _side_by_side(self, some: np.ndarray):
        order = some[np.argsort(-self.length[some], kind="stable")]
        lengths = self.length[order]
        for t in range(int(lengths[0]) if lengths.size else 0):
            yield t, order[: np.searchsorted(-lengths, -t, side="left")]

    def run(self, emission: np.ndarray, trans: np.ndarray):
        """Odds (toxic against clean) at each token: emission, forward with it, backward from what follows."""
        e = np.exp(np.clip(emission, -30, 30))
        t = np.exp(trans)
        forward, backward = np.empty(self.size), np.ones(self.size)
        first, last = self.start, self.start + self.length - 1

        def sweep(some, carry) -> None:
            for k, seg in self._side_by_side(some):
                at = first[seg] + k
                o = carry[seg] if k == 0 else forward[at - 1]
                forward[at] = np.clip(e[at] * (o * t[1, 1] + t[0, 1]) / (o * t[1, 0] + t[0, 0]), 1e-30, 1e30)

        def back(some) -> None:  # backward[last] is set
            for k, seg in self._side_by_side(some):
                if k:
                    at = last[seg] - k
                    o = e[at + 1] * backward[at + 1]
                    backward[at] = np.clip((o * t[1, 1] + t[1, 0]) / (o * t[0, 1] + t[0, 0]), 1e-30, 1e30)

        carry = np.ones(first.size)
        heads, tails = np.flatnonzero(self.depth == 0), np.flatnonzero(self.after == 0)
        for k, seg in self._side_by_side(heads):
            at = first[seg] + k
            if k:
                o = forward[at - 1]
                forward[at] = np.clip(e[at] * (o * t[1, 1] + t[0, 1]) / (o * t[1, 0] + t[0, 0]), 1e-30, 1e30)
            else:
                forward[at] = e[at]
        back(tails)
        inner = np.flatnonzero((self.depth > 0) & (self.after > 0))
        if (self.depth > 0).any():
            ahead, behind = self._maps(inner, e, t)
            place = np.full(first.size, -1)
            place[inner] = np.arange(inner.size)
            deep = int(self.depth.max())
            for d in range(1, deep + 1):
                seg = np.flatnonzero(self.depth == d)
                o = forward[last[seg - 1]] if d == 1 else _apply(ahead[place[seg - 1]], carry[seg - 1])
                carry[seg] = np.clip(o, 1e-30, 1e30)
            sweep(np.flatnonzero(self.depth > 0), carry)
            for d in range(1, deep + 1):
                seg = np.flatnonzero(self.after == d)
                b = backward[first[seg + 1]] if d == 1 else _apply(behind[place[seg + 1]], backward[last[seg + 1]])
                o = e[first[seg + 1]] * b
                backward[last[seg]] = np.clip((o * t[1, 1] + t[1, 0]) / (o * t[0, 1] + t[0, 0]), 1e-30, 1e30)
            back(np.flatnonzero(self.after > 0))
        return e, forward, backward

    def _maps(self, inner: np.ndarray, e: np.ndarray, t: np.ndarray):
        """For each inner segment (all of full length), the forward and the backward map as a 2 x 2 matrix."""
        ahead = np.broadcast_to(np.eye(2), (inner.size, 2, 2)).copy()
        behind = ahead.copy()
        for k in range(_SEGMENT):
            x = e[self.start[inner] + k][:, None]
            a, c = ahead[:, 0], ahead[:, 1]
            ahead = np.stack([x * (t[1, 1] * a + t[0, 1] * c), t[1, 0] * a + t[0, 0] * c], axis=1)
            ahead /= ahead.max(axis=(1, 2), keepdims=True)
            if k < _SEGMENT - 1:
                x = e[self.start[inner] + _SEGMENT - 1 - k][:, None]
                a, c = x * behind[:, 0], behind[:, 1]
                behind = np.stack([t[1, 1] * a + t[1, 0] * c, t[0, 1] * a + t[0, 0] * c], axis=1)
                behind /= behind.max(axis=(1, 2), keepdims=True)
        return ahead, behind


def _apply(m: np.ndarray, o: np.ndarray) -> np.ndarray:
    return (m[:, 0, 0] * o + m[:, 0, 1]) / (m[:, 1, 0] * o + m[:, 1, 1])


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << _BITS, np.float32))
    bias: float = -10.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-10.0, 0, 0, 0]))  # 1, largest, log sum, share

    def tagger(self):
        """A function: texts -> (marginals, first, last, text_of)."""
        emission = np.empty(0)

        def learn(words: list[str]) -> None:
            nonlocal emission
            slots = [[_slot(f) for f in features(w)] for w in words]
            sums = np.add.reduceat(self.weights[np.concatenate(slots)], np.cumsum([0, *map(len, slots)])[:-1]) + self.bias
            emission = np.concatenate([emission, sums])

        def forget() -> None:
            nonlocal emission
            emission = np.empty(0)

        tokens = Tokens(learn, forget)

        def tag(texts: list[str]):
            words, first, last, text_of, sentence = tokens.of(texts)
            if not words.size:
                return np.empty(0), first, last, text_of
            _, forward, backward = Chains(sentence).run(emission[words], self.trans)
            odds = forward * backward
            return odds / (1 + odds), first, last, text_of

        return tag

    def scorer(self):
        """A function: texts -> (scores, spans as lists of (start, end, marginal))."""
        tag = self.tagger()

        def score(texts: list[str]):
            scores, spans = np.empty(len(texts)), []
            for a, z in blocks(texts):
                p, first, last, text_of = tag(texts[a:z])
                scores[a:z] = _sigmoid(summary(p, text_of, z - a) @ self.curve)
                spans += spans_of(p, first, last, text_of, z - a)
            return scores, spans

        return score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summary(p: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """1, the largest marginal, log(1 + sum) and share of toxic tokens of each text."""
    top = np.zeros(n)
    np.maximum.at(top, text_of, p)
    total = np.bincount(text_of, weights=p, minlength=n)
    return np.stack([np.ones(n), top, np.log1p(total), total / np.maximum(np.bincount(text_of, minlength=n), 1)], axis=1)


def spans_of(p: np.ndarray, first: np.ndarray, last: np.ndarray, text_of: np.ndarray, n: int) -> list[list[tuple]]:
    """Offsets of runs of tokens more likely toxic than not, with their largest marginal."""
    out: list[list[tuple]] = [[] for _ in range(n)]
    before = -2
    for k in np.flatnonzero(p >= 0.5).tolist():
        mine = out[text_of[k]]
        if k == before + 1 and mine:
            mine[-1] = (mine[-1][0], int(last[k]), max(mine[-1][2], float(p[k])))
        else:
            mine.append((int(first[k]), int(last[k]), float(p[k])))
        before = k
    return out


def fit(rows: list[tuple[str, int]], steps: int = 40) -> ToxicityModel:
    """From (text, 0 or 1) pairs. Without both labels the model calls nothing toxic (or, lacking clean texts, the base rate)."""
    model = ToxicityModel()
    rows = list(dict.fromkeys(rows))  # copies would count as evidence again
    every = rows
    if len({y for _, y in rows[::3]}) == 2 == len({y for i, (_, y) in enumerate(rows) if i % 3}):
        rows = [r for i, r in enumerate(rows) if i % 3]  # every third text is for the curve alone
    label = np.array([y for _, y in rows], dtype=np.int64)
    n1, n0 = int(label.sum()), int((1 - label).sum()) if label.size else 0
    if not n1 or not n0:
        if n1:
            model.curve = np.array([3.0, 0, 0, 0])
        return model
    vocabulary: list[str] = []
    tokens = Tokens(vocabulary.extend, vocabulary.clear)
    tokens.numbering.memo = tokens.numbering.memo_chars = 1 << 62
    parts, base_text, base_sentence = [], 0, 0
    for a, z in blocks([t for t, _ in rows]):
        words, _, _, text_of, sentence = tokens.of([t for t, _ in rows[a:z]])
        parts.append((words, text_of + base_text, sentence + base_sentence))
        base_text, base_sentence = z, base_sentence + (int(sentence[-1]) if sentence.size else 0) + 1
    words, text_of, sentence = (np.concatenate(x) for x in zip(*parts))
    if not words.size:
        model.curve = np.array([np.log(n1 / n0), 0, 0, 0])
        return model

    # features of each distinct word
    names: dict[str, int] = {}
    lists = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    sizes = np.array([len(x) for x in lists])
    flat, begin = np.concatenate(lists), np.cumsum(sizes) - sizes
    # documents with each feature, by label
    pairs = np.unique(text_of * len(vocabulary) + words)
    doc, word = pairs // len(vocabulary), pairs % len(vocabulary)
    reps = sizes[word]
    got = np.repeat(doc, reps) * len(names) + flat[np.repeat(begin[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
    got = np.unique(got)
    d1 = np.bincount(got % len(names), weights=label[got // len(names)], minlength=len(names))
    d0 = np.bincount(got % len(names), minlength=len(names)) - d1
    share = np.clip(d1 / (d1 + d0), 1e-9, 1 - 1e-9)
    base = n1 / (n1 + n0)
    surprise = (d1 + d0) * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    # by chance in fewer than a tenth of a feature
    telling = (share >= 0.95) & (surprise > np.log(10 * len(names)))
    word_toxic = np.maximum.reduceat(telling[flat], begin)
    y = word_toxic[words] & (label[text_of] == 1)

    # gradient ascent (Adam) on the conditional log-likelihood over distinct words' emissions
    slots = np.array([_slot(f) for f in names])[flat]
    used, col = np.unique(slots, return_inverse=True)
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    chains = Chains(sentence)
    follows = np.concatenate([[False], sentence[1:] == sentence[:-1]])
    prev = np.flatnonzero(follows) - 1
    yi = y.astype(np.int64)
    seen_pairs = np.bincount(yi[prev] * 2 + yi[prev + 1], minlength=4).reshape(2, 2) / max(1, prev.size)
    w, bias, trans = np.zeros(used.size), -3.0, np.zeros((2, 2))
    theta = np.concatenate([w, [bias], trans.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1.0 / max(1, int(y.sum()))
    target = np.bincount(words, weights=y, minlength=len(vocabulary))
    for step in range(1, steps + 1):
        w, bias, trans = theta[: used.size], theta[used.size], theta[used.size + 1 :].reshape(2, 2)
        emission = np.add.reduceat(w[col], begin) + bias
        e, forward, backward = chains.run(emission[words], trans)
        odds = forward * backward
        p = odds / (1 + odds)
        diff = target - np.bincount(words, weights=p, minlength=len(vocabulary))
        # pair marginals
        t = np.exp(trans)
        o, nxt = forward[prev], e[prev + 1] * backward[prev + 1]
        z = t[0, 0] + t[0, 1] * nxt + o * t[1, 0] + o * t[1, 1] * nxt
        expected = np.array([[(t[0, 0] / z).sum(), (t[0, 1] * nxt / z).sum()], [(o * t[1, 0] / z).sum(), (o * t[1, 1] * nxt / z).sum()]]) / max(1, prev.size)
        g = np.concatenate([np.bincount(col, weights=diff[owner], minlength=used.size) * scale, [diff.sum() * scale], (seen_pairs - expected).ravel() * prev.size * scale])
        g -= np.concatenate([1e-3 * w, [0.0], 1e-3 * trans.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.weights = np.zeros(1 << _BITS, np.float32)
    model.weights[used] = theta[: used.size]
    model.bias, model.trans = float(theta[used.size]), theta[used.size + 1 :].reshape(2, 2)
    apart = every[::3] if len(rows) < len(every) else rows
    tag, x = model.tagger(), []
    for a, z in blocks([t for t, _ in apart]):
        p, _, _, text_of = tag([t for t, _ in apart[a:z]])
        x.append(summary(p, text_of, z - a))
    x, label = np.concatenate(x), np.array([y for _, y in apart])
    c = np.zeros(4)
    for _ in range(40):
        q = _sigmoid(x @ c)
        grad = x.T @ (q - label) + 0.02 * c
        change = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(4), grad)
        c -= change
        if np.abs(change).max() < 1e-6:
            break
    model.curve = c
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: dict[int, int], max_chars: int) -> list[tuple[str, int]]:
    """About ``per_label`` labelled texts of either label outside the held-out fold, drawn by a hash of the id."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = {r[0]: r[1] for r in marked.groupBy("_label").count().collect()}
    if not n:
        return []
    part = F.create_map(*[F.lit(x) for y, k in n.items() for x in (y, min(1.0, per_label[y] / k))])
    drawn = (F.xxhash64(F.col("_id").cast("string")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    marked = marked.filter(drawn < part[F.col("_label")])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
    # at most the bounded sample: small enough to send to all tasks
    found = texts.join(F.broadcast(marked), "_id").select("_id", "_text", "_label").collect()
    return [(r[1], r[2]) for r in sorted(found, key=lambda r: (str(r[0]), r[1]))]


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = 600, clean: int = 1200, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample: ``toxic`` and ``clean`` labelled texts of at most ``max_chars`` characters."""
    return fit(training_rows(docs, labels, id_col, text_col, label_col, {1: toxic, 0: clean}, max_chars))


#: What ``tag_toxicity`` adds.
ADDED = [("toxicity", "double"), ("toxic_spans", "array<struct<start:int,end:int,marginal:double>>")]


def tag_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with toxicity (0 to 1) and toxic_spans (character offsets in the text).

    Null and empty texts have no spans and the score of a text without toxic tokens. Repeated rows and null
    ids are scored like any other; columns of the added names are replaced.
    """

    def make():
        score = model.scorer()

        def compute(texts: list[str]):
            scores, spans = score(texts)
            return scores, [[{"start": a, "end": z, "marginal": p} for a, z, p in s] for s in spans]

        return compute

    return with_text_columns(docs, text_col, ADDED, make)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = 600, clean: int = 1200) -> DataFrame:
    """(id, held_out, score, predicted, toxic_spans) for each row, learned from the rows not held out.

    Null texts count as empty; texts are scored whole, however long, repeated rows and null ids like any other. An id
    labelled both ways counts as toxic. A score of one half is toxic. Other columns are ignored, whatever their names;
    an empty table gives an empty result, and without labels nothing is called toxic.
    """
    model = learn_toxicity(docs, labels, id_col, text_col, label_col, toxic, clean)
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text"), held_out(id_col).alias("held_out"))
    found = tag_toxicity(rows, model, "_text")
    return found.select(id_col, "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
