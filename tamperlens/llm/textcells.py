"""Words of a batch of texts as NumPy arrays: positions, 64-bit hashes, shingles.

A word is a maximal run of characters other than ASCII punctuation, blanks and
controls (ASCII letters, digits and everything beyond ASCII), lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("0") : ord("9") + 1] = True
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[ord("A") : ord("Z") + 1] = True
_WORD_BYTE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:  # doubling keeps this vectorised
        factor = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * factor
        done += take
    return out


@dataclass
class Words:
    """Words of a batch; ``doc`` is the text's index, ascending."""

    data: np.ndarray  # bytes of all texts, a blank after each
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray  # 64-bit hash of the word
    docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def words_of(texts: list[str | None], lower: bool = True) -> Words:
    """Whole texts, whatever their length; None counts as empty."""
    parts = [
        ((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts
    ]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # a blank closes the data, so edges come in pairs
    doc = np.searchsorted(np.cumsum(lengths), start, side="right")
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    code = (sums[end] - sums[start]) * _powers(_INVERSE, n)[start] if len(start) else sums[:0]
    return Words(data, start, end, doc, mix(code), len(parts))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, 64-bit hash) of all k-word shingles, sorted by doc, then hash.

    A text of fewer than k words, but at least one, has its whole word row as its
    only shingle; a text without words has none.
    """
    n = len(words.code)
    counts = words.counts()
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    weights = _powers(_BASE, k + 1)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        rolled += words.code[i : n - k + 1 + i] * weights[i] if n >= k else rolled
    whole = words.doc[: n - k + 1] == words.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    hashes, docs = rolled[whole], words.doc[: n - k + 1][whole] if n >= k else words.doc[:0]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += words.code[first[short[has]] + i] * weights[i]
        extra += counts[short].astype(np.uint64) * weights[k]
        hashes, docs = np.concatenate((hashes, extra)), np.concatenate((docs, short))
    hashes = mix(hashes)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return docs[keep], hashes[keep]


def batches(texts: list[str | None], most: int = 1 << 20):
    """Index ranges of about ``most`` characters; a longer text is a batch of its own."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)
