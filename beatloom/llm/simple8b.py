"""Word-aligned coding of token ids (Simple-8b with escapes), vectorised with numpy.

A 64-bit word holds a 4-bit selector and 60 bits of payload: a number of ids of equal width. The code of
all ones at a width is an escape; the id itself then stands in the exception list of its block. Blocks of
1,024 ids are coded independently, so that many blocks are coded and decoded side by side: the work per
step runs over all blocks at once.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the published code: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
ESCAPES = np.array([(1 << int(w)) - 1 if w else 0 for w in WIDTHS], np.uint64)
BLOCK_DTYPE = np.dtype([("word_at", "<u8"), ("exception_at", "<u8"), ("words", "<u4"), ("exceptions", "<u4"), ("ids", "<u4")])


def _longest(high: np.ndarray) -> int:
    """Length of the longest run without a mark."""
    at = np.flatnonzero(high)
    return int(max(at[0], len(high) - 1 - at[-1], (at[1:] - at[:-1]).max(initial=1) - 1)) if len(at) else len(high)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, exceptions and a block table (places count words and exceptions) of an array of ids below 2^32 - 1."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.zeros(blocks, BLOCK_DTYPE)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), table
    ids = ids.astype(np.uint32, copy=False)
    if ids.max() == 0xFFFFFFFF:
        raise ValueError("the largest 32-bit number is no id")
    # Leave out selectors that never fit, and all that are wider than one that always fits.
    use, before = [], []  # before[k][i]: ids before i that selector k can hold only by an escape
    for k, escape in enumerate(ESCAPES.tolist()):
        high = ids >= min(escape, 0xFFFFFFFF) if k > 1 else ids != 0
        if WIDTHS[k] > 6 or _longest(high) >= COUNTS[k]:
            use.append(k)
            before.append(np.zeros(n + 1, np.int32))
            np.cumsum(high, out=before[-1][1:])
        if use and not high.any():
            break
    sels, counts, narrow = np.array(use), COUNTS[use].astype(np.int32)[:, None], int((WIDTHS[use] <= 6).sum())
    before = np.concatenate(before)
    flat, offset = before, (np.arange(len(use)) * (n + 1))[:, None]
    pos = np.arange(blocks) * BLOCK
    ends = np.minimum(pos + BLOCK, n)
    lanes, steps = np.arange(blocks), []
    while len(lanes):
        p, end = pos[lanes], ends[lanes]
        upto = np.minimum(p + counts, end)
        wrong = flat.take(upto + offset) - flat.take(p + offset)
        bits = (64 + 32 * wrong).astype(np.float32) / (upto - p).astype(np.float32)
        bits[:narrow][wrong[:narrow] > 0] = np.inf
        best = bits.argmin(0)
        after = upto[best, np.arange(len(lanes))]
        steps.append((lanes, p, sels[best], after - p))
        pos[lanes] = after
        lanes = lanes[after < end]
    lane = np.concatenate([s[0] for s in steps])
    per_block = np.bincount(lane, minlength=blocks)
    first = np.cumsum(per_block) - per_block
    place = np.concatenate([first[s[0]] + i for i, s in enumerate(steps)])
    p, sel, took = (np.empty(len(lane), np.int64) for _ in range(3))
    for i, column in enumerate((p, sel, took), 1):
        column[place] = np.concatenate([s[i] for s in steps])
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint32)])
    for k in np.unique(sel[sel > 1]):
        at = np.flatnonzero(sel == k)
        lanes_of = np.arange(COUNTS[k])
        codes = np.minimum(padded[p[at, None] + lanes_of].astype(np.uint64), ESCAPES[k])
        codes[lanes_of >= took[at, None]] = 0
        words[at] |= np.bitwise_or.reduce(codes << (lanes_of * int(WIDTHS[k])).astype(np.uint64), axis=1)
    bound = np.minimum(ESCAPES, 0xFFFFFFFF).astype(np.uint32)
    bound[:2] = 0xFFFFFFFF
    escaped = np.flatnonzero(ids >= np.repeat(bound[sel], took))
    table["words"] = per_block
    table["exceptions"] = np.bincount(escaped // BLOCK, minlength=blocks)
    table["word_at"] = np.cumsum(table["words"]) - table["words"]
    table["exception_at"] = np.cumsum(table["exceptions"]) - table["exceptions"]
    table["ids"] = ends - np.arange(blocks) * BLOCK
    return words.astype("<u8"), ids[escaped].astype("<u4"), table


def decode(words: np.ndarray, exceptions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, from their words and exceptions."""
    total = int(table["ids"].sum())
    out = np.zeros(total, np.uint32)
    if not total:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(table)), table["words"])
    upto = np.cumsum(COUNTS[sel])
    first = np.cumsum(table["words"].astype(np.int64)) - table["words"]
    base = np.concatenate([[0], upto])[first]
    begins = np.cumsum(table["ids"].astype(np.int64)) - table["ids"]
    start = begins[block] + upto - COUNTS[sel] - base[block]
    took = np.minimum(COUNTS[sel], (begins + table["ids"])[block] - start)
    escaped = np.zeros(total, bool)
    for k in np.unique(sel[sel > 1]):
        at = np.flatnonzero(sel == k)
        lanes_of = np.arange(COUNTS[k])
        codes = (words[at, None] >> (lanes_of * int(WIDTHS[k])).astype(np.uint64)) & ESCAPES[k]
        real = lanes_of < took[at, None]
        place = (start[at, None] + lanes_of)[real]
        codes = codes[real]
        out[place] = codes
        escaped[place[codes == ESCAPES[k]]] = True
    out[escaped] = exceptions
    return out
