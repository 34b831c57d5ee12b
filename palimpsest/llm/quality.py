"""Quality of documents by a convolutional network over their bytes.

A text is cut into chunks of 256 bytes that overlap by half and together cover all of it. Learned filters see
eight bytes at once, each as a few learned numbers and one that says whether the four bytes from there stood just
before. They are evaluated at every byte and max-pooled in each chunk; a hidden layer reads the pooled chunk, and
the largest and the mean hidden values of all chunks give one probability. Gradients flow through the places where
a filter was largest alone, so a training step costs little more than its forward pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty, with_text_columns
from .toxicity import training_rows
from .words import blocks

#: Bytes a filter sees, positions in half a chunk, the number that stands for no byte, and how far back an echo reaches.
WIDTH, HALF, NONE, REACH = 8, 128, 256, 32


def laid_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each behind ``REACH`` empty places and filled up to whole halves of chunks, and the
    number of halves of each. Neither filters nor echoes reach from one text into another."""
    halves = np.array([-(-(len(r) + REACH) // HALF) for r in raws])
    out = np.full(int(halves.sum()) * HALF + REACH, NONE, dtype=np.uint16)
    for r, at in zip(raws, (np.cumsum(halves) - halves) * HALF + REACH):
        out[at : at + len(r)] = np.frombuffer(r, np.uint8)
    return out, halves


def echoes(codes: np.ndarray) -> np.ndarray:
    """1 where the four bytes from a place on also begin at most ``REACH`` places before, else 0."""
    c = codes.astype(np.uint32)
    four = c[:-3] + c[1:-2] * np.uint32(257) + c[2:-1] * np.uint32(257**2) + c[3:] * np.uint32(257**3)
    found = np.zeros(codes.size, dtype=bool)
    for lag in range(1, REACH + 1):
        found[lag : four.size] |= four[lag:] == four[:-lag]
    found &= codes != NONE
    return found.astype(np.float32)


@dataclass
class QualityModel:
    """``constant``: the score of every text where there was nothing to learn from."""

    embed: np.ndarray  # (257, d), the last row zero
    filters: np.ndarray  # (WIDTH * (d + 1), f)
    bias: np.ndarray  # (f,)
    hidden: np.ndarray  # (f + 1, h)
    out: np.ndarray  # (2 h + 1,)
    constant: float | None = None

    @staticmethod
    def begin(d: int, f: int, h: int, seed: int) -> QualityModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        embed = draw(257, d, by=0.5)
        embed[NONE] = 0
        return QualityModel(embed, draw(WIDTH * (d + 1), f, by=(1 / (WIDTH * d * 0.25)) ** 0.5), np.zeros(f, np.float32), draw(f + 1, h, by=(2 / f) ** 0.5), draw(2 * h + 1, by=0.1))

    def halves(self, codes: np.ndarray, where: bool = False):
        """Largest value of each filter in each half of a chunk (and where it was); 64 halves at a time."""
        n, d, f = (codes.size - REACH) // HALF, self.embed.shape[1] + 1, self.bias.size
        top = np.empty((n, f), np.float32)
        at = np.empty((n, f), np.int64) if where else None
        for a in range(0, n, 64):
            z = min(n, a + 64)
            before = REACH if a else 0
            near = codes[a * HALF - before : z * HALF + WIDTH + 2]
            x = np.concatenate([self.embed[near], echoes(near)[:, None]], axis=1)[before:]
            windows = np.lib.stride_tricks.as_strided(x, ((z - a) * HALF, WIDTH * d), (x.strides[0], x.strides[1]), writeable=False)
            y = (np.ascontiguousarray(windows) @ self.filters).reshape(z - a, HALF, f)
            if where:
                k = y.argmax(1)
                at[a:z] = k + (np.arange(a, z) * HALF)[:, None]
                top[a:z] = np.take_along_axis(y, k[:, None], 1)[:, 0]
            else:
                y.max(1, out=top[a:z])
        return (top, at) if where else top

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text, whole; a text's score does not depend on those beside it."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        for a, z in blocks(texts):
            codes, n = laid_out([t.encode("utf-8", "surrogatepass") for t in texts[a:z]])
            out[a:z] = self.combine(self.halves(codes), n)[-1]
        return out

    def combine(self, top: np.ndarray, n: np.ndarray):
        """From halves to probabilities; all that the backward pass needs is returned along."""
        end = np.cumsum(n)
        start = end - n
        left = np.arange(len(top))
        right = np.minimum(left + 1, np.repeat(end, n) - 1)  # a text's last chunk is its last half alone
        pooled = np.maximum(top, top[right])
        seen = np.maximum(pooled + self.bias, 0)
        deep = np.maximum(seen @ self.hidden[:-1] + self.hidden[-1], 0)
        most, mean = np.maximum.reduceat(deep, start), np.add.reduceat(deep, start) / n[:, None]
        z = np.concatenate([most, mean], axis=1) @ self.out[:-1] + self.out[-1]
        return left, right, seen, deep, most, mean, 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def step(self, codes: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean logistic loss of a few texts."""
        echo = echoes(codes)
        top, at = self.halves(codes, where=True)
        left, right, seen, deep, most, mean, p = self.combine(top, n)
        loss = float(-np.log(np.where(y == 1, p, 1 - p)).mean())
        dz = ((p - y) / len(y)).astype(np.float32)
        h, d = deep.shape[1], self.embed.shape[1]
        g_out = np.concatenate([np.concatenate([most, mean], axis=1).T @ dz, [dz.sum()]])
        text_of = np.repeat(np.arange(len(n)), n)
        d_deep = (dz / n)[text_of][:, None] * self.out[h : 2 * h]
        winner = (deep == most[text_of]) & (deep > 0)
        share = np.add.reduceat(winner.astype(np.float32), np.cumsum(n) - n)
        d_deep = d_deep + winner * (dz[text_of][:, None] * self.out[:h] / np.maximum(share, 1)[text_of])
        d_deep *= deep > 0
        g_hidden = np.concatenate([seen.T @ d_deep, d_deep.sum(0, keepdims=True)])
        d_seen = (d_deep @ self.hidden[:-1].T) * (seen > 0)
        half = np.where(top >= top[right], left[:, None], right[:, None])
        place = np.take_along_axis(at, half, 0)  # where each filter was largest in each chunk
        chunk, which = np.nonzero(d_seen)
        v, pos = d_seen[chunk, which], place[chunk, which]
        places = pos[:, None] + np.arange(WIDTH)
        bytes_of = codes[places]
        x = np.concatenate([self.embed[bytes_of], echo[places][..., None]], axis=2).reshape(len(v), WIDTH * (d + 1)) * v[:, None]
        order = np.argsort(which, kind="stable")
        g_filters = np.zeros_like(self.filters)
        if len(v):
            first = np.flatnonzero(np.diff(which[order], prepend=-1))
            g_filters[:, which[order][first]] = np.add.reduceat(x[order], first).T
        back = (self.filters.T[which] * v[:, None]).reshape(-1, d + 1)
        flat = bytes_of.ravel()
        g_embed = np.stack([np.bincount(flat, weights=back[:, j], minlength=257) for j in range(d)], axis=1).astype(np.float32)
        g_embed[NONE] = 0
        return [g_embed, g_filters, d_seen.sum(0), g_hidden, g_out], loss


def fit(rows: list[tuple[str, int]], epochs: int = 12, d: int = 4, f: int = 48, h: int = 24, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> QualityModel:
    """From (text, 0 or 1) pairs, by Adam; with one label alone every text gets the base rate."""
    rows = list(dict.fromkeys(rows))
    model = QualityModel.begin(d, f, h, seed)
    y = np.array([v for _, v in rows], dtype=np.float64)
    if not rows or y.min() == y.max():
        model.constant = 0.5 if not rows else (1 + y.sum()) / (2 + y.size)
        return model
    raws = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    rng = np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "hidden", "out")
    m, s = ([np.zeros_like(getattr(model, k)) for k in names] for _ in range(2))
    steps, t = epochs * -(-len(rows) // batch), 0
    model.out[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            mine = order[a : a + batch]
            grads, _ = model.step(*laid_out([raws[i] for i in mine]), y[mine])
            t += 1
            now = rate * min(1.0, t / 20) * (1 - (t - 1) / steps)
            for i, (k, g) in enumerate(zip(names, grads)):
                w = getattr(model, k)
                g = g + 1e-4 * w
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                setattr(model, k, (w - now * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32))
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: int = 1600, poor: int = 800, max_chars: int = 20_000) -> QualityModel:
    """Fit on a bounded sample: about ``good`` and ``poor`` labelled texts of at most ``max_chars`` characters."""
    return fit(training_rows(docs, labels, id_col, text_col, label_col, {1: good, 0: poor}, max_chars))


def add_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with quality, 0 to 1; a column of that name is replaced."""
    return with_text_columns(docs, text_col, [("quality", "double")], lambda: lambda texts: [model.scores(texts)])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: int = 1600, poor: int = 800, accept: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for each row, learned from labelled rows that are not held out.

    Null texts count as empty and have the score of an empty text; texts are scored whole, however long, repeated
    rows and null ids like any other. An id labelled both ways counts as good. A score of ``accept`` is predicted good.
    Other columns are ignored, whatever their names. An empty table gives an empty result; with labels of one kind
    alone every text has their base rate, without any the score is one half.
    """
    model = learn_quality(docs, labels, id_col, text_col, label_col, good, poor)
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text"), held_out(id_col).alias("held_out"))
    found = add_quality(rows, model, "_text")
    return found.select(id_col, "held_out", F.col("quality").alias("score"), (F.col("quality") >= accept).cast("int").alias("predicted"))
