"""Words of many texts at once: found, hashed and numbered with numpy inside a task."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

#: Slots of the memo, by the upper bits of a word's hash, and neighbours tried before the slow lookup.
_SLOT_BITS, _PROBES = 21, 4
_SLOT_MASK = (1 << _SLOT_BITS) - 1

SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


@cache
def kinds() -> np.ndarray:
    """SPACE, LETTER, DIGIT or MARK for each code point below 65536; those above count as the last one."""
    table = np.full(0x10000, MARK, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        table[c] = SPACE if ch.isspace() else LETTER if ch.isalpha() else DIGIT if ch.isdigit() else MARK
    table[0xFFFF] = LETTER
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_powers: list[np.ndarray] = []


def span_hashes(cp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of cp[first:last] for each span."""
    if not _powers or _powers[0].size < cp.size + 1:
        base = 0x9E3779B97F4A7C15
        m = 1 << int(cp.size).bit_length()
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    power, inverse = _powers
    mixed = (cp.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= power[: cp.size]
    sums = np.zeros(cp.size + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return (sums[last] - sums[first]) * inverse[first]


class WordNumbers:
    """Numbers 0, 1, ... for distinct words.

    A word is looked up by a 64-bit hash and then compared with the word of that number, character by character:
    words of one hash that differ get numbers of their own. ``learn`` is called with the words not met before, in
    the order of their numbers; ``forget`` before the numbers start afresh, after ``memo`` words or ``memo_chars``
    characters of them.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], memo: int = 1_000_000, memo_chars: int = 1 << 24):
        self.learn, self.on_forget, self.memo, self.memo_chars = learn, forget, memo, memo_chars
        self._forget()

    def _forget(self) -> None:
        self.on_forget()
        self.known: dict[int, int] = {}
        self.others: dict[str, int] = {}  # words whose hash another word had first
        self.slot_hash, self.slot_word = np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, -1, np.int32)
        self.chars, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def numbers(self, text: str, cp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The number of text[first:last] for each span, in text order; ``cp`` are the code points of ``text``."""
        if len(self.known) + len(self.others) > self.memo or self.chars.size > self.memo_chars:
            self._forget()
        h = span_hashes(cp, first, last)
        words = np.full(h.size, -1, dtype=np.int32)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        for probe in range(_PROBES):
            todo = np.flatnonzero(words < 0) if probe else slice(None)
            at = (slot[todo] + probe) & _SLOT_MASK
            words[todo] = np.where(self.slot_hash[at] == h[todo], self.slot_word[at], -1)
        todo = np.flatnonzero(words < 0)
        if todo.size:
            distinct, at, which = np.unique(h[todo], return_index=True, return_inverse=True)
            words[todo] = self._number(text, distinct, first[todo[at]], last[todo[at]])[which]
        for k in self._differing(cp, first, last, words).tolist():
            word = text[first[k] : last[k]]
            j = self.others.get(word)
            if j is None:
                self.others[word] = j = self.size.size
                self._add([word])
            words[k] = j
        return words

    def _differing(self, cp: np.ndarray, first: np.ndarray, last: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Spans that are not the word of their number."""
        same = self.size[words] == last - first
        some = np.flatnonzero(same & (last > first))
        done = np.cumsum((last - first)[some])
        a = 0
        while a < some.size:  # about a million characters at a time
            z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + (1 << 20), side="right")))
            at = some[a:z]
            n = last[at] - first[at]
            begin = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(begin, n)
            equal = cp[np.repeat(first[at], n) + step] == self.chars[np.repeat(self.start[words[at]], n) + step]
            if not equal.all():
                same[at[~np.logical_and.reduceat(equal, begin)]] = False
            a = z
        return np.flatnonzero(~same)

    def _add(self, fresh: list[str]) -> None:
        self.learn(fresh)
        sizes = np.array([len(w) for w in fresh], dtype=np.int64)
        self.start = np.concatenate([self.start, self.chars.size + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.chars = np.concatenate([self.chars, code_points("".join(fresh))])

    def _number(self, text: str, distinct: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        index = np.empty(distinct.size, dtype=np.int64)
        known, fresh, n = self.known, [], self.size.size
        for k, (x, a, z) in enumerate(zip(distinct.tolist(), first.tolist(), last.tolist())):
            j = known.get(x)
            if j is None:
                known[x] = j = n + len(fresh)
                fresh.append(text[a:z])
            index[k] = j
        if fresh:
            self._add(fresh)
            h, j = distinct, index
            for probe in range(_PROBES):
                at = ((h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64) + probe) & _SLOT_MASK
                free = self.slot_word[at] < 0
                self.slot_hash[at[free]], self.slot_word[at[free]] = h[free], j[free]
                lost = self.slot_hash[at] != h
                h, j = h[lost], j[lost]
        return index


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last positions of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks(texts: list[str], chars: int = 1 << 21):
    """Consecutive index ranges of ``texts`` of about ``chars`` characters; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
