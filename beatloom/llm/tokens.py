"""Token ids of whole texts with a given tokenizers file, fast enough for a corpus.

Byte-pair merging is by far the dearest part, and it never crosses a boundary between pre-tokens. So texts
are cut at places that are boundaries for certain, and the ids of distinct pieces are kept in a memo of
bounded bytes, which a worker process drops when it has had nothing to encode for some seconds. Texts whose white space is unusual are cut at fewer places; ids never differ from encoding
the whole text at once (tests compare both).
"""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two characters that are no white space.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces with these are encoded alone.
SPECIAL = re.compile(r"<\||[\s\u0120]")
#: Where lower-casing may differ between libraries, or make a special token of a text.
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]|\u0130|<\|")
ODD_SPACE = re.compile(r" \s|\s |^ | $")


#: Bytes that a piece takes in the memo beside its characters and ids: two objects and a place in the table.
ENTRY = 150
MEMO = 448 << 20
IDLE = 3.0  # seconds until an unused memo is dropped


class Memo:
    """Ids of pieces in two generations: once the young one is half the bound, it takes the old one's place.

    Pieces met again in the old generation move to the young one, so frequent pieces stay.
    """

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def add(self, new: dict[str, bytes]) -> None:
        self.young.update(new)
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))

    def age(self) -> None:
        """Called between slices: within a slice every piece added stays in reach."""
        if self.size > self.most // 2:
            self.young, self.old, self.size = {}, self.young, 0

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0


class Encoder:
    """Ids of texts. ``spaced``: the pre-tokenizer keeps a space before a word (byte-level kind); otherwise
    white space is dropped. ``memo`` bounds the bytes of pieces kept; ``part`` the characters at work."""

    def __init__(self, path: str, spaced: bool, memo: int = MEMO, part: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.spaced, self.part, self.memo = spaced, part, Memo(memo)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.marks = {m: np.array(ids("a" + m)[len(ids("a")) :], self.dtype).tobytes() for m in ",."}
        self.lowers = not spaced and ids("ABC ÀŽ Ǆ") == ids("abc àž ǆ")
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.startswith("\u0120") if spaced else t.endswith("</w>"))]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], out: list[bytes], which: list[int], between: str, edge: np.ndarray, first: bool) -> None:
        """Encode pieces many at a time; ``edge`` marks the ids that start (``first``) or end each piece."""
        groups, size = [which[at : at + 128] for at in range(0, len(which), 128)], self.dtype.itemsize
        for group, ids in zip(groups, self._ids([between.join(pieces[i] for i in g) for g in groups]), strict=True):
            raw, at = ids.tobytes(), np.flatnonzero(edge[ids]).tolist()
            bounds = [*at, len(ids)] if first else [0, *(i + 1 for i in at)]
            for i, j, k in zip(group, bounds[:-1], bounds[1:], strict=True):
                out[i] = raw[j * size : k * size]

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Most are encoded many at a time and told apart in the ids: by the space that opens
        each of them, or by the mark that closes a word; those with unusual characters are encoded alone."""
        out: list[bytes] = [b""] * len(pieces)
        if self.spaced:
            many = [i for i, p in enumerate(pieces) if not SPECIAL.search(p, 1)]
        else:
            many = [i for i, p in enumerate(pieces) if p.lower().isalpha()]
        alone = sorted(set(range(len(pieces))).difference(many))
        for i, ids in zip(alone, self._ids([pieces[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        self._joined(pieces, out, many, "" if self.spaced else " ", self.edge, self.spaced)
        return out

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """A head to encode as it stands and the pieces after it."""
        if not self.spaced:
            if self.lowers and not BEYOND_LATIN.search(text):
                text = text.lower()
            return "", text.replace("\n", " ").split(" ")
        head, *rest = LONE_SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return head, rest

    def _known(self, cuts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as pieces."""
        self.memo.age()
        known, old = self.memo.young, self.memo.old
        found = [list(map(known.get, pieces)) for pieces in cuts]
        missing = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = {pieces[i] for pieces, at in zip(cuts, missing, strict=True) for i in at}
        again = new.intersection(old)
        self.memo.add({p: old[p] for p in again})
        new -= again
        # A comma or full stop after letters is a pre-token of its own: the ids of the word are mostly known.
        marked = [p for p in new if p[-1:] in self.marks and p[:-1].isalpha()]
        plain = list(new.difference(marked).union(p[:-1] for p in marked).difference(known))
        again = [p for p in plain if p in old]
        self.memo.add({p: old[p] for p in again})
        plain = [p for p in plain if p not in old]
        self.memo.add(dict(zip(plain, self._plain([" " + p for p in plain] if self.spaced else plain), strict=True)))
        self.memo.add({p: known[p[:-1]] + self.marks[p[-1]] for p in marked})
        for pieces, f, at in zip(cuts, found, missing, strict=True):
            for i in at:
                f[i] = known[pieces[i]]
        return [b"".join(f) for f in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian bytes of ``dtype``."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            with _LOCK:
                _USED["at"] = float("inf")
                if not _USED["watched"]:
                    _USED["watched"] = True
                    threading.Thread(target=_watch, daemon=True).start()
            size, end = 0, at
            while end < len(texts) and size <= self.part:
                size += len(texts[end])
                end += 1
            cuts = [self._cut(t) for t in texts[at:end]]
            heads = [ids.tobytes() for ids in self._ids([h for h, _ in cuts])] if self.spaced else [b""] * len(cuts)
            out += [head + ids for head, ids in zip(heads, self._known([rest for _, rest in cuts]), strict=True)]
            at = end
        with _LOCK:
            _USED["at"] = time.monotonic()
        return out


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}
_USED = {"at": 0.0, "watched": False}
_LOCK = threading.Lock()


def _watch() -> None:
    """Drop the memos of a worker process once it is idle: later stages run in the same processes."""
    while True:
        time.sleep(IDLE)
        with _LOCK:
            if time.monotonic() - _USED["at"] > IDLE:
                for one in _ENCODERS.values():
                    one.memo.clear()
                _USED["watched"] = False
                return


def encoder(path: str, spaced: bool, memo: int = MEMO) -> Encoder:
    """The encoder of this worker process; its memo outlives a task for a few seconds."""
    if (path, spaced, memo) not in _ENCODERS:
        _ENCODERS[path, spaced, memo] = Encoder(path, spaced, memo)
    return _ENCODERS[path, spaced, memo]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 23) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about ``most`` bytes of text, with the texts; null texts are empty."""
    texts = batch.column(column)
    lengths = np.array(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at), [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end
