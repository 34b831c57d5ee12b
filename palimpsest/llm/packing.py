"""Packing of documents into sequences by the sum-of-squares rule.

Each document becomes ids (vocabulary ids, then an end id). Whole windows of a long document are
sequences at once; its remainder goes, as it arrives, to the fill level h for which the sum over all
levels of (number of partly filled windows at that level) squared becomes smallest. The counts are held in
one array by level. Each input partition packs its own documents, so no row moves. What is partly filled
when a partition ends is cut into full windows; the last of them falls into powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_or_empty
from .token_counts import byte_chars
from .words import DIGIT, SPACE, WordNumbers, code_points, kinds

#: Anything but these goes through the library: no apostrophes (contractions), no characters with
#: composition, casing or white-space rules of their own.
_OTHER = re.compile("[^\t\n\r\x20-\x26\x28-\x7e¡-§©«¬®°±¶·»¿-ÿŒœ–—“-„…€]")


class WordEncoder:
    """ids of many texts for a BPE of lower-case words with an end-of-word suffix.

    Words are found and numbered over a whole batch of texts with numpy; each distinct word is encoded once
    and remembered (``memo`` words at most, then afresh).
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.plain = model["type"] == "BPE" and bool(suffix) and "Lowercase" in json.dumps(spec.get("normalizer"))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        if self.plain:
            # the end of a word is the byte 255, which UTF-8 never holds; ranks in the order of merging
            chars = byte_chars()
            raw = lambda t: bytes(chars[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix)
            order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255)]
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            order += [raw(a + b) for a, b in merges]
            ranks: dict[bytes, int] = {}
            for t in order:
                ranks.setdefault(t, len(ranks))
            to_id = np.zeros(len(ranks), dtype=np.uint32)
            for t, i in vocab.items():
                if t not in added and (r := ranks.get(raw(t))) is not None:
                    to_id[r] = i
            self.to_id = to_id
            self.piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.numbering = WordNumbers(self._learn, self._forget, memo)

    def _forget(self) -> None:
        self.flat, self.lengths, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = [self.piece(w.encode() + b"\xff") for w in words]
        self.flat = np.concatenate([self.flat, self.to_id[np.array([i for p in ids for i in p])]])
        self.lengths = np.concatenate([self.lengths, np.array([len(p) for p in ids], dtype=np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """One uint32 array a text, closed by ``end``."""
        easy = [self.plain and not _OTHER.search(t) and not (self.special and "<" in t and self.special.search(t)) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, ok in enumerate(easy):
            if not ok:
                out[i] = np.array([*self.library.encode(texts[i], add_special_tokens=False).ids, end], dtype=np.uint32)
        block: list[int] = []
        size = 0
        for i, ok in enumerate(easy):
            if ok:
                block.append(i)
                size += len(texts[i]) + 1
                if size > 1 << 21:
                    self._block(texts, block, out, end)
                    block, size = [], 0
        if block:
            self._block(texts, block, out, end)
        return out

    def _block(self, texts: list[str], block: list[int], out: list, end: int) -> None:
        joined = "\n".join([texts[i] for i in block]).lower() + "\n"
        cp = code_points(joined)
        ends = np.cumsum([len(texts[i]) + 1 for i in block])
        kind = kinds()[cp]
        before, after = np.concatenate([[SPACE], kind[:-1]]), np.concatenate([kind[1:], [SPACE]])
        first = np.flatnonzero((kind != SPACE) & ((kind != before) | (kind == DIGIT)))
        last = np.flatnonzero((kind != SPACE) & ((kind != after) | (kind == DIGIT))) + 1
        words = self.numbering.numbers(joined, cp, first, last)
        n_ids = self.lengths[words]
        done = np.concatenate([[0], np.cumsum(n_ids)])
        ids = self.flat[np.repeat(self.starts[words] - done[:-1], n_ids) + np.arange(done[-1])] if words.size else np.empty(0, np.uint32)
        cut = done[np.searchsorted(first, np.concatenate([[0], ends]), side="left")]
        tail = np.array([end], dtype=np.uint32)
        for k, i in enumerate(block):
            out[i] = np.concatenate([ids[cut[k] : cut[k + 1]], tail])


class Windows:
    """Partly filled windows of one partition, by fill level."""

    def __init__(self, size: int, number: int):
        self.size, self.next_id = size, number
        self.count = np.zeros(size + 1, dtype=np.int64)  # windows at each level
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += ids.size
        self.next_id += 1

    def place(self, piece: tuple) -> None:
        """Into the level with the smallest sum of squares afterwards; a fuller window on ties."""
        s, b, n = piece[2].size, self.size, self.count
        level, best = 0, 2 * n[s] + 1
        if n[b - s]:
            level, best = b - s, min(best, 1 - 2 * n[b - s]) if 1 - 2 * n[b - s] <= best else best
        below = n[1 : b - s]
        if (at := np.flatnonzero(below)).size:
            change = 2 * (n[at + 1 + s] - below[at] + 1)
            k = change.size - 1 - int(np.argmin(change[::-1]))
            if change[k] < best:
                level, best = int(at[k]) + 1, change[k]
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            n[level] -= 1
        if level + s == b:
            self.emit(window)
        else:
            n[level + s] += 1
            self.open.setdefault(level + s, []).append(window)

    def add(self, doc, ids: np.ndarray) -> None:
        whole = ids.size // self.size * self.size
        for a in range(0, whole, self.size):
            self.emit([(doc, a, ids[a : a + self.size], ids.size)])
        if whole < ids.size:
            self.place((doc, whole, ids[whole:].copy(), ids.size))

    def close(self) -> None:
        """Cut what is left into full windows and the rest into powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        rest = sum(p[2].size for p in left)
        sizes = [self.size] * (rest // self.size) + [1 << k for k in range(self.size.bit_length(), -1, -1) if rest % self.size >> k & 1]
        at = 0
        for size in sizes:
            window = []
            while size:
                doc, start, ids, total = left[at]
                take = min(size, ids.size)
                window.append((doc, start, ids[:take], total))
                size -= take
                if take == ids.size:
                    at += 1
                else:
                    left[at] = (doc, start + take, ids[take:], total)
            self.emit(window)
        self.open, self.count[:] = {}, 0

    def taken(self) -> list[tuple]:
        """What is closed by now: (id, start, length, crc32, tokens of the document, sequence, offset)."""
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null texts count as empty: the end id alone. Long texts are cut into whole windows and a rest. Rows that repeat
    an id, or have none, are packed each on its own; other columns are ignored, whatever their names. An empty table gives no pieces. Sequences hold ``size`` ids, or a power of two.
    Memory: one batch of texts, the memo and the partly filled windows.
    """
    kind = docs.schema[id_col].dataType
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [to_arrow_type(kind), *[pa.int64()] * 6]  # ids stay as they are, also beside nulls

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(v), type=t) for v, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        windows = Windows(size, TaskContext.get().partitionId() << 36)
        for b in batches:
            for doc, ids in zip(b.column("_id").to_pylist(), encoder.encode(b.column("_text").to_pylist(), end_id)):
                windows.add(doc, ids)
            yield batch(windows.taken())
        windows.close()
        yield batch(windows.taken())

    pieces = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, f"_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("_id", id_col)
