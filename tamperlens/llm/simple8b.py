"""Simple-8b word-aligned coding of token ids, in NumPy over whole blocks.

Ids are cut into blocks of ``BLOCK``. In a block each 64-bit word holds a selector in its
top four bits and as many ids as fit at that selector's width, all decoded alike. An id
of ``ESCAPE`` or more is written as ``ESCAPE``; its real value stands in the block's list
of escapes, in order. The word and escape offsets of every block are kept, so blocks
decode independently and at once.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
#: fixed values of the format: ids in a word and bits of each, by selector
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 15) - 1
MAGIC = b"S8B1"
_LAST = WIDTHS.index(15)  # with escapes no id is wider; the wider selectors stay unused
_PAD = 64
_HEAD = "<4sqqqq"  # magic, documents, ids, words, escapes


def _choices(values: np.ndarray) -> np.ndarray:
    """At each place of the padded blocks the selector that packs the most ids from there."""
    flat = np.concatenate((values.reshape(-1), np.zeros(_PAD, np.uint16)))
    n = values.size
    widest = {1: flat}
    for count in (2, 4, 8, 16, 32):  # maxima over windows, by doubling
        half = widest[count // 2]
        widest[count] = np.maximum(half[: len(half) - count // 2], half[count // 2 :])
    best = np.full(n, _LAST, np.uint8)
    for selector in range(_LAST - 1, -1, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        size = 1 << (count.bit_length() - 1)
        top = np.maximum(widest[size][:n], widest[size][count - size : count - size + n])
        fits = top < (1 << width)
        if not fits.any():
            break  # no narrower selector fits either, as its window is longer
        best[fits] = selector
    return best.reshape(values.shape)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes, first escape of each block)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    escaped = ids >= ESCAPE
    escapes = ids[escaped].astype(np.uint32)
    starts = np.arange(blocks, dtype=np.int64) * BLOCK
    escape_at = np.searchsorted(np.flatnonzero(escaped), starts)
    filled = np.zeros(blocks * BLOCK, np.uint16)
    filled[:n] = np.minimum(ids, ESCAPE)
    # zeros after each block, so that its last word may reach past its end
    values = np.zeros((blocks, BLOCK + _PAD), np.uint16)
    values[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    selector = _choices(values)
    size = np.minimum(BLOCK, n - starts)
    heads, owner, at, left = [], [], np.zeros(blocks, np.int64), np.arange(blocks)
    counts = np.array(COUNTS, np.int64)
    while len(left):  # one word of every unfinished block at a time
        heads.append(at[left])
        owner.append(left)
        at[left] += counts[selector[left, at[left]]]
        left = left[at[left] < size[left]]
    if not heads:
        return np.zeros(0, np.uint64), starts, escapes, escape_at
    head, owner = np.concatenate(heads), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    head, owner = head[order] + owner[order] * (BLOCK + _PAD), owner[order]
    flat = values.reshape(-1)
    chosen = selector.reshape(-1)[head]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in range(_LAST + 1):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            total = np.zeros(len(mine), np.uint64)
            for i in range(COUNTS[k]):
                total |= flat[head[mine] + i].astype(np.uint64) << np.uint64(i * WIDTHS[k])
            words[mine] |= total
    return words, np.searchsorted(owner, np.arange(blocks)), escapes, escape_at


def unpack(words, block_word, escapes, block_escape, n: int) -> np.ndarray:
    """All ids; every selector's words are opened together."""
    counts, widths = np.array(COUNTS), WIDTHS
    chosen = (words >> np.uint64(60)).astype(np.int64)
    blocks = len(block_word)
    word_block = np.searchsorted(block_word, np.arange(len(words)), side="right") - 1
    taken = counts[chosen] if len(words) else np.zeros(0, np.int64)
    before = np.cumsum(taken) - taken
    place = before - before[block_word[word_block]] + word_block * BLOCK if len(words) else before
    stop = np.minimum((np.arange(blocks) + 1) * BLOCK, n)[word_block] if blocks else place
    out = np.zeros(n, np.uint32)
    for k in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == k)
        mask = np.uint64((1 << widths[k]) - 1)
        for i in range(COUNTS[k]) if len(mine) else ():
            inside = place[mine] + i < stop[mine]
            part = mine[inside]
            out[place[part] + i] = ((words[part] >> np.uint64(i * widths[k])) & mask).astype(np.uint32)
    out[out == ESCAPE] = escapes
    return out


def write_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file: head, document table (id, has an id, length), block offsets, words, escapes."""
    words, block_word, escapes, block_escape = pack(ids)
    return b"".join(
        [
            struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), len(words), len(escapes)),
            doc_ids.astype("<i8").tobytes(),
            known.astype("u1").tobytes(),
            lengths.astype("<u4").tobytes(),
            block_word.astype("<u4").tobytes(),
            block_escape.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u4").tobytes(),
        ]
    )


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, whether known, lengths) of a file."""
    magic, docs, n, n_words, n_escapes = struct.unpack_from(_HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token file of this format")
    at, blocks = struct.calcsize(_HEAD), -(-n // BLOCK)

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, known, lengths = part("<i8", docs), part("u1", docs).astype(bool), part("<u4", docs)
    block_word, block_escape = part("<u4", blocks).astype(np.int64), part("<u4", blocks).astype(np.int64)
    words, escapes = part("<u8", n_words), part("<u4", n_escapes)
    return unpack(words, block_word, escapes, block_escape, n), doc_ids, known, lengths
