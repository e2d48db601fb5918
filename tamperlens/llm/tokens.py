"""Byte-level BPE ids of whole texts, each distinct piece of text encoded once.

A byte-level BPE never merges across the pieces of its splitting rule. So a batch is
split into pieces with NumPy, equal pieces are found by Arrow's dictionary encoding, and
only pieces not met before are handed to the tokenizers library. Texts with characters
beyond ASCII and Latin letters up to U+017F, and texts that hold an added token of the
tokenizer such as <|endoftext|>, go to the library whole.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from tamperlens.llm.textcells import batches

BLANK, LETTER, DIGIT, OTHER, FOREIGN = range(5)
_PLAIN_END = 0x180
#: fixed values: endings that the splitting rule keeps with their apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    kinds = np.full(_PLAIN_END + 1, OTHER, np.uint8)  # the last entry: all that lies beyond
    for code in range(128):
        char = chr(code)
        if char.isalpha():
            kinds[code] = LETTER
        elif char.isdigit():
            kinds[code] = DIGIT
        elif char in "\t\n\v\f\r ":
            kinds[code] = BLANK
    kinds[0x80:0xC0] = FOREIGN
    kinds[0xC0:_PLAIN_END] = LETTER
    kinds[[0xD7, 0xF7]] = OTHER
    kinds[_PLAIN_END] = FOREIGN
    return kinds


_KINDS = _classes()


def piece_starts(chars: np.ndarray, kinds: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """First characters of the pieces of joined plain texts (code points).

    The rule: letters, digits or other characters in a row form a piece, with one space
    before it; blanks that no piece takes stand alone; an ending such as 's goes with an
    apostrophe that opens a piece.
    """
    n = len(chars)
    first = np.zeros(n, bool)
    first[text_start[text_start < n]] = True
    change = first.copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    kind = kinds[start]
    inner = ~first[start]  # a run that follows another one in its text
    last_of_text = np.append(first[start[1:]], True)
    space_end = (kind == BLANK) & (chars[end - 1] == 32)
    joined = np.zeros(len(start), bool)
    joined[1:] = space_end[:-1] & inner[1:]  # two blank runs never touch inside a text
    mark = np.zeros(n + 1, bool)
    solid = kind != BLANK
    mark[start[solid] - joined[solid]] = True
    blank = ~solid
    alone = blank & (last_of_text | (end - start > 1) | ~space_end)
    mark[start[alone]] = True
    tail = blank & ~last_of_text & ~space_end
    mark[end[tail] - 1] = True
    quote = np.flatnonzero(
        (kind[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (chars[start[:-1]] == 39)
        & ~joined[:-1] & (kind[1:] == LETTER) & inner[1:]
    )
    for run in quote:
        a, b = start[run + 1], end[run + 1]
        head = "".join(map(chr, chars[a : min(a + 2, b)]))
        for ending in ENDINGS:
            if head.startswith(ending):
                mark[a] = False
                if a + len(ending) < b:
                    mark[a + len(ending)] = True
                break
    return np.flatnonzero(mark[:n])


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first bytes of a word


def short_keys(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pieces, first word, second word): the bytes of pieces of at most 16 bytes.

    Bytes beyond the end are zero, so two pieces have equal words only if one is the other
    followed by NUL characters; texts with such characters are not looked up this way.
    """
    offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
    begin, length = offsets[:-1], np.diff(offsets)
    data = np.zeros(offsets[-1] + 16, np.uint8)
    if offsets[-1]:
        data[:-16] = np.frombuffer(pieces.buffers()[2], np.uint8, offsets[-1])
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
    short = np.flatnonzero(length <= 16)
    begin, length = begin[short], length[short]
    low = words[begin] & _KEEP[np.minimum(length, 8)]
    return short, low, words[begin + 8] & _KEEP[np.maximum(length, 8) - 8]


class ShortPieces:
    """Hash table from :func:`short_keys` to slots, read and filled by whole arrays."""

    def __init__(self, bits: int = 20):
        self.bits, self.held = bits, 0
        self.slot = np.full(1 << bits, -1, np.int32)
        self.low = np.zeros(1 << bits, np.uint64)
        self.high = np.zeros(1 << bits, np.uint64)

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not held."""
        at, found = self._place(low, high), np.full(len(low), -1, np.int32)
        left = np.arange(len(low))
        while len(left):
            slot = self.slot[at]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (slot >= 0)
            found[left[same]] = slot[same]
            on = ~same & (slot >= 0)  # another key stands here
            left, at = left[on], (at[on] + 1) & (len(self.slot) - 1)
        return found

    def add(self, low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        """Hold distinct keys that are not held yet, as long as a quarter stays free."""
        if self.held + len(low) > 3 * len(self.slot) // 4:
            return
        self.held += len(low)
        at, left = self._place(low, high), np.arange(len(low))
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = slots[left[free]]  # of several keys for one place one stays
            stands = free & (self.slot[at] == slots[left])
            self.low[at[stands]], self.high[at[stands]] = low[left[stands]], high[left[stands]]
            left, at = left[~stands], (at[~stands] + 1) & (len(self.slot) - 1)


class PieceEncoder:
    """Encoder with a bounded memory of pieces, for use inside one Python worker.

    A piece takes about 300 bytes. When ``most_pieces`` are known, the third that was met
    most often is kept. Texts are taken ``slice_chars`` characters at a time, which bounds
    the arrays of a step.
    """

    def __init__(self, path: str, most_pieces: int = 400_000, slice_chars: int = 1 << 20):
        # a task has one core; a thread for each of the machine would take memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_pieces = most_pieces
        self.slice_chars = slice_chars
        vocabulary = self.tokenizer.get_vocab()
        # a byte-level token has one character for each byte of text
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for token, number in vocabulary.items():
            self.width[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.short = ShortPieces()  # slots of short pieces, whose strings need not be made
        self.begin = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, np.int32)  # slices that held the piece
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _keep_frequent(self) -> None:
        """Forget all pieces but the third met most often; their counts are halved."""
        known = len(self.slot)
        often = np.argpartition(self.met[:known], known - known // 3)[known - known // 3 :]
        often = often[self.met[often] > 1]
        stays = np.zeros(known, bool)
        stays[often] = True
        pieces = [p for p, at in self.slot.items() if stays[at]]  # in order of their slots
        rows = np.flatnonzero(stays)
        lengths, met = self.length[rows], self.met[rows]
        ends = np.cumsum(lengths)
        source = np.repeat(self.begin[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[source]
        self._forget()
        self._remember(pieces, ids, lengths)
        self.met[: len(pieces)] = met // 2

    def _remember(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        slots = len(self.slot)
        while slots + len(pieces) > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
            self.met = np.concatenate((self.met, np.zeros_like(self.met)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.begin[slots : slots + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[slots : slots + len(pieces)] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(pieces, range(slots, slots + len(pieces))))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; runs of " word" pieces go through the library as one text."""
        words, others = [], []
        for piece in pieces:
            (words if piece[0] == " " and piece[1:2].isalpha() else others).append(piece)
        for at in range(0, len(words), 1024):
            group = words[at : at + 1024]
            joined = "".join(group)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            token_ends = np.cumsum(self.width[ids])
            sizes = map(len, group if joined.isascii() else map(str.encode, group))
            piece_ends = np.cumsum(np.fromiter(sizes, np.int64, len(group)))
            last = np.searchsorted(token_ends, piece_ends)
            if last[-1] < len(ids) and (token_ends[last] == piece_ends).all():
                self._remember(group, ids, np.diff(last, prepend=-1))
            else:  # the library splits otherwise: one by one
                others.extend(group)
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(found), np.uint32)
            self._remember(others, flat, np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, number of ids of each text)."""
        ids, counts = [], []
        for begin, end in batches(texts, self.slice_chars):
            flat, lengths = self._encode_batch([t or "" for t in texts[begin:end]])
            ids.append(flat)
            counts.append(lengths)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        kinds = _KINDS[np.minimum(chars, _PLAIN_END)]
        foreign = np.add.reduceat(np.append(kinds == FOREIGN, False), np.append(starts, len(chars)))[:-1]
        odd = (foreign > 0) & (sizes > 0)
        for token in self.added:
            if token in joined:
                odd |= np.fromiter((token in t for t in texts), bool, len(texts))
        odd = np.flatnonzero(odd)
        if len(odd):
            return self._encode_mixed(texts, set(odd.tolist()))
        return self._encode_plain(joined, chars, kinds, starts, sizes)

    def _encode_mixed(self, texts: list[str], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        plain = [t for i, t in enumerate(texts) if i not in odd]
        flat, lengths = self._encode_batch(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        cuts = np.split(flat, np.cumsum(lengths)[:-1]) if plain else []
        whole = self.tokenizer.encode_batch_fast([texts[i] for i in sorted(odd)], add_special_tokens=False)
        theirs = iter([np.array(e.ids, np.uint32) for e in whole])
        ours = iter(cuts)
        parts = [next(theirs) if i in odd else next(ours) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode_plain(self, joined, chars, kinds, starts, sizes):
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        begin = piece_starts(chars, kinds, starts[sizes > 0])
        wide = np.cumsum(chars >= 0x80, dtype=np.int32)  # these take two bytes
        ends = np.append(begin[1:], len(chars)).astype(np.int32)
        offsets = np.append(np.int32(0), ends + wide[ends - 1])
        pieces = pa.StringArray.from_buffers(
            len(begin), pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8"))
        ).dictionary_encode()
        distinct = pieces.dictionary
        if len(self.slot) + len(distinct) > self.most_pieces:
            self._keep_frequent()
        slots = np.full(len(distinct), -1, np.int32)
        short, low, high = short_keys(distinct)
        if "\0" in joined:
            short, low, high = short[:0], low[:0], high[:0]
        slots[short] = self.short.find(low, high)
        missed = np.flatnonzero(slots < 0)
        if len(missed):
            strings = distinct.take(pa.array(missed)).to_pylist()
            slots[missed] = np.fromiter(map(self.slot.get, strings, repeat(-1)), np.int32, len(strings))
            unknown = [strings[i] for i in np.flatnonzero(slots[missed] < 0).tolist()]
            if unknown:
                self._learn(unknown)
                slots[slots < 0] = np.fromiter(map(self.slot.__getitem__, unknown), np.int32, len(unknown))
            late = np.zeros(len(distinct), bool)
            late[missed] = True
            late = late[short]
            self.short.add(low[late], high[late], slots[short[late]])
        self.met[slots] += 1  # distinct pieces have distinct slots
        index = pieces.indices.to_numpy()
        lengths = self.length[slots][index]
        ends = np.cumsum(lengths, dtype=np.int32)
        source = np.repeat(self.begin[slots][index] - (ends - lengths), lengths)
        source += np.arange(len(source), dtype=np.int32)
        text_of = np.searchsorted(starts + sizes, begin, side="right")
        counts = np.bincount(text_of, weights=lengths, minlength=len(sizes)).astype(np.int64)
        return self.ids[source], counts


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, kept from task to task.

    Functions reach a worker by value, so the encoder lives in a module of its own.
    """
    held = sys.modules.setdefault("_tamperlens_worker", types.ModuleType("_tamperlens_worker"))
    encoders = held.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]


def drop_encoders() -> None:
    """Free the encoders of this Python worker, for tasks that only read what others encoded."""
    held = sys.modules.get("_tamperlens_worker")
    if held is not None:
        held.__dict__.pop("encoders", None)
