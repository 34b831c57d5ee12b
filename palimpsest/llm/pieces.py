"""SentencePiece ids and back, by a streaming Viterbi search.

The text (a space in front, every space the piece mark) is a lattice of vocabulary pieces. Each position keeps
one backpointer: the last piece of the encoding of the text up to it. For a merge-based vocabulary a piece may
follow another exactly if merging the two together would leave that boundary alone, and this admits one piece
at each position; for a unigram vocabulary the piece with the best sum of scores is kept. Pieces have a largest
length, so only that many positions stay in the window, and ids are committed as soon as the paths from all
of them meet in one boundary. A boundary between two characters that no piece holds side by side is one on which
all paths meet: texts fall apart there, and what lies between is searched once and remembered.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_columns
from .words import WordNumbers, blocks, code_points

MARK = "▁"


class Vocabulary:
    """Pieces, scores, byte pieces and kind of a model file, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id), default=1)
        # merge vocabularies have whole negative numbers in order as scores
        self.merges = all(s == int(s) for s in self.score.values())
        inside = {(p[k], p[k + 1]) for p in self.id for k in range(len(p) - 1)}
        self.inside = np.array(sorted(ord(a) << 21 | ord(b) for a, b in inside), dtype=np.int64)
        # lengths of the pieces that end in two given characters, longest first
        tails: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self.pairs: dict[int, bool] = {}
        self._whole: dict[str, bool] = {}
        self._born: dict[str, float] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        # pieces of several characters that merging arrives at
        self.solid = {p: i for p, i in self.id.items() if len(p) > 1 and self.whole(p)} if self.merges else {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """A short text by merging its characters, best score first, leftmost on ties, down to ``stop`` parts."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        """Whether its characters merge into this piece; if so, its last merge is remembered."""
        found = self._whole.get(piece)
        if found is None:
            parts = self.merged(piece, 2)
            found = self._whole[piece] = len(parts) == 2 and parts[0] + parts[1] in self.score or len(piece) == 1
            if found and len(piece) > 1:
                self._born[piece], self._halves[piece] = 1 - self.score[piece], (parts[0], parts[1])
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging two pieces (ids, or characters as negative numbers) never joins across their boundary.

        Time runs back from when both are whole: the one made last falls into its halves, and what then faces
        the boundary must not have been worth joining before that merge. Equal scores merge leftmost first.
        """
        key = (left << 22) + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            a, b = (self.piece[i] if i >= 0 else chr(-i) for i in (left, right))
            until, found = float("inf"), True
            while True:
                joined = self.score.get(a + b)
                if joined is not None and 1 - joined < until:
                    found = False
                    break
                made_a, made_b = self._born.get(a, 0), self._born.get(b, 0)
                if not made_a and not made_b:
                    break
                if made_a > made_b:
                    until, a = made_a, self._halves[a][1]
                else:
                    until, b = made_b + 0.5, self._halves[b][0]
            self.pairs[key] = found
        return found

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers: its bytes, or the unknown id."""
        raw = char.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if self.byte else [self.unknown]


def viterbi(v: Vocabulary, text: str) -> list[int]:
    """Ids of one stretch of text, committed as the paths of the window converge."""
    ids: list[int] = []
    n, longest = len(text), v.longest
    back: dict[int, int] = {}  # position -> start of its last piece, from the last committed boundary on
    best: dict[int, float] = {0: 0.0}
    last: dict[int, int] = {}  # the last piece at each position of the window
    done = 0

    def commit(end: int) -> None:
        nonlocal done
        path, at = [], end
        while at > done:
            path.append((back[at], at))
            at = back[at]
        for a, z in reversed(path):
            i = v.id.get(text[a:z])
            ids.extend([i] if i is not None else v.fallback(text[a:z]))
        if end < n:
            for at in [x for x in back if x <= end]:
                del back[at]
        done = end

    solid, tails, pairs = (v.solid, v.tails, v.pairs) if v.merges else ({}, {}, {})
    for j in range(1, n + 1):
        if v.merges:
            start, piece = j - 1, -ord(text[j - 1])
            for size in tails.get(text[j - 2 : j], ()) if j > 1 else ():
                i = j - size
                if i >= 0 and (p := solid.get(text[i:j])) is not None:
                    if i and (ok := pairs.get((last[i] << 22) + p)) is None:
                        ok = v.may_follow(last[i], p)
                    if not i or ok:
                        start, piece = i, p
                        break
            back[j], last[j] = start, piece
        else:
            top = None
            for i in range(max(0, j - longest), j):
                s = v.score.get(text[i:j])
                if s is None and j == i + 1:
                    s = -1e6
                if s is not None and i in best and (top is None or best[i] + s > top):
                    top, back[j] = best[i] + s, i
            best[j] = top
            best.pop(j - longest - 1, None)
        if j - done >= 4 * longest and j < n:
            # walk all live paths back together: the latest boundary they share
            live = set(range(max(done, j - longest + 1), j + 1))
            while len(live) > 1:
                far = max(live)
                live.discard(far)
                if far > done:
                    live.add(back[far])
                if done in live:
                    break
            if len(live) == 1 and (shared := live.pop()) > done:
                commit(shared)
                for at in [x for x in last if x < j - longest]:
                    del last[at]
    commit(n)
    return ids


@cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("a  b ", " a", "\ufb01 \u2460", "e\u0301 A"):
        if sp.decode(sp.encode(text)) != text:
            raise ValueError(f"{path} normalises texts, which this search does not")
    return Vocabulary(path)


class Encoder:
    """Ids of many texts: cut where no piece reaches across, each distinct stretch searched once."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.numbering = WordNumbers(self._learn, self._forget, memo=600_000)

    def _forget(self) -> None:
        self.flat, self.lengths, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        found = [viterbi(self.v, s) for s in stretches]
        self.flat = np.concatenate([self.flat, np.array([i for f in found for i in f], dtype=np.int32)])
        self.lengths = np.concatenate([self.lengths, np.array([len(f) for f in found], dtype=np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, z in blocks(texts):
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts[a:z]]
            joined = "".join(marked)
            ends = np.cumsum([len(t) for t in marked])
            if not joined:
                out += [np.empty(0, np.int32)] * (z - a)
                continue
            cp = code_points(joined)
            pair = cp[:-1].astype(np.int64) << 21 | cp[1:]
            near = np.flatnonzero((cp[:-1] < 0x2600) & (cp[1:] < 0x2600))
            apart = np.ones(pair.size, dtype=bool)
            table = self._near()
            apart[near] = ~table[cp[near].astype(np.int64) * 0x2600 + cp[near + 1]]
            rest = np.setdiff1d(np.arange(pair.size), near, assume_unique=True)
            if rest.size:
                apart[rest] = ~np.isin(pair[rest], self.v.inside)
            cut = np.concatenate([[True], apart])
            cut[ends[:-1][ends[:-1] < cp.size]] = True
            first = np.flatnonzero(cut)
            last = np.append(first[1:], cp.size)
            words = self.numbering.numbers(joined, cp, first, last)
            n = self.lengths[words]
            done = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.starts[words] - done[:-1], n) + np.arange(done[-1])]
            edge = done[np.searchsorted(first, np.concatenate([[0], ends]), side="left")]
            out += [ids[edge[k] : edge[k + 1]] for k in range(z - a)]
        return out

    def _near(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(0x2600 * 0x2600, dtype=bool)
            a, b = self.v.inside >> 21, self.v.inside & ((1 << 21) - 1)
            ok = (a < 0x2600) & (b < 0x2600)
            self._table[a[ok] * 0x2600 + b[ok]] = True
        return self._table


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of ids: pieces and runs of bytes joined, marks as spaces, the space in front taken off."""
    parts: list[bytes] = []
    for i in ids:
        if i in v.byte_of:
            parts.append(bytes([v.byte_of[i]]))
        elif i not in v.control:
            parts.append(" ⁇ ".encode() if i == v.unknown else v.piece[i].replace(MARK, " ").encode())
    text = b"".join(parts).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text; null and empty texts have none. Other columns pass untouched."""

    def make():
        encoder = Encoder(model_path)
        return lambda texts: [encoder.encode(texts)]

    return with_text_columns(df, text_col, [(ids_col, "array<int>")], make)


def decode_texts(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids decode to an empty text."""
    import pyarrow as pa

    kept = df.drop(text_col)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), f"`{text_col}` string"])

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            texts = [decode_ids(v, ids or []) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())], names=[*b.schema.names, text_col])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_ids, ids_crc32, exact): the ids of each whole text and whether they decode to it.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers. Null texts count as empty. Texts are
    encoded whole, however long; repeated rows and null ids have a row each. Other columns are ignored, whatever
    their names; an empty table gives an empty result. Models that normalise texts are refused.
    """
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def make():
        import zlib

        encoder = Encoder(model_path)
        table = _byte_table(encoder.v)

        def compute(texts: list[str]):
            found = encoder.encode(texts)
            exact = [table.text(ids) == t for ids, t in zip(found, texts)]
            return [len(x) for x in found], [zlib.crc32(x.astype("<u4").tobytes()) for x in found], exact

        return compute

    made = with_text_columns(rows, "_text", [("n_ids", "long"), ("ids_crc32", "long"), ("exact", "boolean")], make)
    return made.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), "n_ids", "ids_crc32", "exact")


class _byte_table:
    """Decoding of many ids at once: the bytes of all pieces in one array."""

    def __init__(self, v: Vocabulary):
        raw = [bytes([v.byte_of[i]]) if i in v.byte_of else b"" if i in v.control else " ⁇ ".encode() if i == v.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(v.piece)]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        done = np.cumsum(n)
        raw = self.flat[np.repeat(self.start[ids] - (done - n), n) + np.arange(int(done[-1]) if done.size else 0)]
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text
