"""CRC-32 of any word n-gram from running CRCs of the text before it, for many texts at once.

For texts A and B, crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where ``shift`` appends zero bytes and is
linear over GF(2). So one running CRC over a separator-normalised text, read at the two ends of an n-gram,
gives the CRC of the n-gram: shift the first to the length and cancel it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

POLYNOMIAL = 0xEDB88320
BLOCK = 256
#: Bytes of words, A-Z lowered; every other byte becomes a space.
FOLD = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    FOLD[_low:_high] = np.arange(_low, _high)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Shifts:
    """Tables for appending zero bytes: per base-256 digit of the length and byte of the register."""

    def __init__(self) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, one >> 1 ^ np.uint32(POLYNOMIAL), one >> 1)
        self.one = one
        level = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
        unit = [one[p & 255] ^ p >> 8 for p in level]
        self.levels = []
        for _ in range(4):
            tables = np.empty((257, 4, 256), np.uint32)
            tables[0] = level
            for q in range(256):
                tables[q + 1] = self._apply(np.array(unit), tables[q])
            self.levels.append(tables[:256].reshape(-1).copy())
            unit = tables[256]

    @staticmethod
    def _apply(unit: np.ndarray, v: np.ndarray) -> np.ndarray:
        return unit[0][v & 255] ^ unit[1][v >> 8 & 255] ^ unit[2][v >> 16 & 255] ^ unit[3][v >> 24]

    def _digit(self, level: int, v: np.ndarray, digit: np.ndarray) -> np.ndarray:
        t, at = self.levels[level], digit.astype(np.int64) << 10
        return t[at + (v & 255)] ^ t[at + 256 + (v >> 8 & 255)] ^ t[at + 512 + (v >> 16 & 255)] ^ t[at + 768 + (v >> 24)]

    def shift(self, v: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC registers after as many zero bytes as given for each."""
        out = self._digit(0, v, length & 255)
        for level in range(1, 4):
            far = np.flatnonzero(length >> 8 * level & 255)
            if len(far):
                out[far] = self._digit(level, out[far], length[far] >> 8 * level & 255)
        return out

    def running(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A reader of the CRC of every prefix: called with prefix lengths, it gives their CRCs.

        All blocks of the data advance together, byte by byte; a block then adds what came before it.
        """
        blocks = len(data) // BLOCK + 1
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[: len(data)] = data
        lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        local, c = np.zeros((BLOCK, blocks), np.uint32), np.zeros(blocks, np.uint32)
        for i in range(BLOCK):
            local[i] = c
            c = self.one[(c ^ lanes[i]) & 255] ^ c >> 8
        t0, t1, t2, t3 = (self.levels[1][1024 + 256 * j : 1280 + 256 * j].tolist() for j in range(4))
        carry, register = np.empty(blocks, np.uint32), 0xFFFFFFFF
        for b, end in enumerate(c.tolist()):
            carry[b] = register
            register = t0[register & 255] ^ t1[register >> 8 & 255] ^ t2[register >> 16 & 255] ^ t3[register >> 24] ^ end

        def read(length: np.ndarray) -> np.ndarray:
            block, offset = length // BLOCK, length % BLOCK
            return local[offset, block] ^ self._digit(0, carry[block], offset) ^ np.uint32(0xFFFFFFFF)

        return read


_SHIFTS: list[Shifts] = []


def shifts() -> Shifts:
    """The tables of this worker process, 4 MB."""
    if not _SHIFTS:
        _SHIFTS.append(Shifts())
    return _SHIFTS[0]


def ngram_crcs(data: np.ndarray, bounds: np.ndarray, most: int = 3, context: int = 0) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text and, for n = 1 to ``most``, (text number, CRC) of every run of n of its words.

    ``data`` holds the UTF-8 bytes of the texts, text t from ``bounds[t]`` to ``bounds[t + 1]``. The first
    ``context`` words, of the first text, are only context: no n-gram that ends in them is given.
    """
    folded = FOLD[data]
    inside = folded != 0x20
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    first = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - first
    text = np.searchsorted(bounds, first, "right") - 1
    words = np.bincount(text[context:], minlength=len(bounds) - 1)
    # one space before every word, nothing else between them
    end = np.cumsum(length + 1)
    start = end - length
    clean = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    letters = np.ones(len(clean), bool)
    letters[start - 1] = False
    clean[letters] = folded[inside]
    tables = shifts()
    read = tables.running(clean)
    at_start, at_end = read(start), read(end)

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in range(1, most + 1):
            i = np.arange(max(0, context + 1 - n), max(0, len(start) - n + 1))
            i = i[text[i] == text[i + n - 1]]
            j = i + n - 1
            yield text[i], at_end[j] ^ tables.shift(at_start[i], end[j] - start[i])

    return words, grams()
