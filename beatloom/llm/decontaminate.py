"""Benchmark passages in documents, within an edit distance over words.

CGK random walks embed word sequences so that few edits give few differing places: the walk copies the word
it stands on at every step and moves on by a random bit that depends on the step and the word, so two walks
over nearly equal sequences fall back into step. Repeated bit sampling makes keys of the copied words: in
each repetition, a few steps are sampled over a window as long as the items of a size class, and windows and
items with equal keys are compared by exact edit distance. The number of repetitions follows from a recall
target (``tests/llm`` measures it against brute force).

Most texts share nothing with any item, so walks start only where an item can stand at all: each edit breaks
two word pairs and three word triples at most, so the words of a match hold a known number of pairs and
triples that occur in items. This condition does not look at which item they are from, and loses no match.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.tokens import slices

WORD = re.compile(r"\w+")
SIMILARITY = 0.8
ITEMS = 20_000  # items of one block; more items mean more passes over the documents
PART = 1 << 21  # bytes of text whose words are held at once
REPETITIONS, SAMPLED = 32, 3
SCHEMA = "doc_id long, item_id long, distance int, similarity double, start_word long, end_word long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edit_row(item: np.ndarray, text: np.ndarray, anchored: bool) -> np.ndarray:
    """Edit distances of the item to text parts, by end; they may start anywhere or, ``anchored``, at 0."""
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least distance and the first place, start and end, that has it."""
    row = edit_row(item, text, anchored=False)
    end = int(row.argmin())
    back = edit_row(item[::-1], text[:end][::-1], anchored=True)
    return int(row[end]), end - int(back.argmin()), end


class Index:
    """Items of one block: words, pairs and the keys of their walks."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, repetitions: int = REPETITIONS, sampled: int = SAMPLED, seed: int = 11) -> None:
        self.numbers: dict[str, int] = {}
        self.items, self.ids = [], []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                self.items.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64))
                self.ids.append(item_id)
        self.lengths = np.array([len(i) for i in self.items], np.int64)
        self.edits = np.floor((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        self.base = len(self.numbers) + 1
        self.grams = [np.unique(np.concatenate([self._grams(i, q) for i in self.items])) if self.items else np.zeros(0, np.int64) for q in (2, 3)]
        self.reach = int((self.lengths + self.edits).max(initial=1))
        # By size class: the longest match, and the fewest pairs and triples of known words in one.
        self.bounds = []
        size = np.array([self._size_class(n) for n in self.lengths.tolist()], np.int64)
        for c in np.unique(size):
            n, k = self.lengths[size == c], self.edits[size == c]
            self.bounds.append((int((n + k).max()), *(int((n - q + 1 - q * k).min()) for q in (2, 3))))
        rng = np.random.default_rng(seed)
        self.classes = sorted({self._size_class(n) for n in self.lengths.tolist()})
        steps = math.ceil(1.6 * max(self.classes, default=1))
        self.factor = rng.integers(1, 1 << 62, (repetitions, steps)) * 2 + 1
        self.samples = {c: np.sort(rng.integers(0, max(1, math.ceil(1.6 * c)), (repetitions, sampled)), axis=1) for c in self.classes}
        self.mixer = rng.integers(1, 1 << 62, sampled) * 2 + 1
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for c in self.classes:
            own = np.flatnonzero([self._size_class(n) == c for n in self.lengths.tolist()])
            text = np.concatenate([np.append(self.items[k], np.zeros(c, np.int64)) for k in own])
            starts = np.cumsum([0, *(len(self.items[k]) + c for k in own[:-1])])
            keys = self.keys(text, starts)[c]
            self.tables[c] = []
            for row in keys:
                table: dict[int, list[int]] = defaultdict(list)
                for key, k in zip(row.tolist(), own.tolist(), strict=True):
                    table[key].append(k)
                self.tables[c].append(dict(table))

    @staticmethod
    def _size_class(n: int) -> int:
        """Window length of an item: the largest step of a ladder by factors of 1.2 that it reaches."""
        return n if n < 6 else math.floor(5 * 1.2 ** math.floor(math.log(n / 5, 1.2) + 1e-9))

    def keys(self, text: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
        """By size class, the keys of the walks from each start, one row per repetition."""
        out = {c: np.zeros((len(self.factor), len(starts)), np.int64) for c in self.classes}
        text = np.append(text, np.zeros(1, np.int64))
        for r, factors in enumerate(self.factor):
            at, copied = starts.copy(), np.empty((len(factors), len(starts)), np.int64)
            for j, factor in enumerate(factors):
                word = text[np.minimum(at, len(text) - 1)]
                copied[j] = word
                at += ((word + 1) * factor >> 41) & 1
            for c in self.classes:
                out[c][r] = (copied[self.samples[c][r]] * self.mixer[:, None]).sum(0)
        return out

    def _grams(self, ids: np.ndarray, q: int) -> np.ndarray:
        """A number for every run of q known words (zero if one is unknown)."""
        out, known = np.zeros(max(0, len(ids) - q + 1), np.int64), np.ones(max(0, len(ids) - q + 1), bool)
        for i in range(q):
            part = ids[i : len(ids) - q + 1 + i]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, 0)

    def starts(self, text: np.ndarray) -> np.ndarray:
        """Places where a match can start: enough of what follows are pairs and triples of known words."""
        n, sums = len(text), []
        for q, grams in zip((2, 3), self.grams, strict=True):
            own, known = self._grams(text, q), np.zeros(n, bool)
            at = np.flatnonzero(own)
            known[at] = np.isin(own[at], grams)
            sums.append(np.concatenate([[0], np.cumsum(known)]))
        may, at = np.zeros(n, bool), np.arange(n)
        for longest, pairs, triples in self.bounds:
            enough = [s[np.minimum(at + longest - q + 1, n)] - s[:-1] >= need for q, s, need in zip((2, 3), sums, (pairs, triples), strict=True)]
            may |= enough[0] & enough[1]
        return np.flatnonzero(may)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """Matches in texts: text number, item number, distance, first word and end word."""
        if not self.items:
            return []
        words, gap = [words_of(t) for t in texts], np.zeros(self.reach, np.int64)
        parts = [x for line in words for x in (np.fromiter(map(self.numbers.get, line, repeat(0)), np.int64, len(line)), gap)]
        text = np.concatenate(parts) if parts else gap
        begins = np.cumsum([0, *(len(line) + self.reach for line in words)])
        ends = begins[:-1] + [len(line) for line in words]
        starts, hits = self.starts(text), defaultdict(list)
        starts = starts[starts < ends[np.searchsorted(begins, starts, "right") - 1]]  # none in a gap
        for at in range(0, len(starts), 1 << 15):
            some = starts[at : at + (1 << 15)]
            for c, rows in self.keys(text, some).items():
                for row, table in zip(rows, self.tables[c], strict=True):
                    which = np.flatnonzero(np.isin(row, np.fromiter(table, np.int64, len(table))))
                    for key, p in zip(row[which].tolist(), some[which].tolist(), strict=True):
                        for k in table[key]:
                            hits[k].append(p)
        out = {}
        for k, places in hits.items():
            places = np.unique(places)
            owner = np.searchsorted(begins, places, "right") - 1
            groups = np.split(places, np.flatnonzero((np.diff(places) > self.reach) | (np.diff(owner) > 0)) + 1)
            for group in groups:
                number = int(np.searchsorted(begins, group[0], "right")) - 1
                lo = max(int(begins[number]), int(group[0]) - self.reach)
                hi = min(int(ends[number]), int(group[-1]) + 2 * self.reach)
                distance, start, end = best_match(self.items[k], text[lo:hi])
                if distance <= self.edits[k]:
                    lo -= int(begins[number])
                    out[number, k] = min(out.get((number, k), (1 << 30, 0, 0)), (distance, lo + start, lo + end))
        return [(number, k, *rest) for (number, k), rest in sorted(out.items())]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = ITEMS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The stated items in blocks of bounded size."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    blocks = max(1, math.ceil(rows.count() / most))
    for b in range(blocks):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that occurs in it: distance, similarity and the words it spans.

    An item of n words occurs where its edit distance to a stretch of words is at most (1 - similarity) n;
    words are runs of letters, digits and underscores, in lower case. The least distance counts, then the
    first place. Null and empty texts and items match nothing, repeated items and rows match each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = []
    for items in item_blocks(benchmark):
        index = Index(items, similarity)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, 1, PART):
                    hits = index.find(texts)
                    columns = [[part.column(0)[i].as_py() for i, *_ in hits], [index.ids[h[1]] for h in hits], [h[2] for h in hits], [1 - h[2] / len(index.items[h[1]]) for h in hits], [h[3] for h in hits], [h[4] for h in hits]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "similarity", "start_word", "end_word"])

        found.append(rows.mapInArrow(run, SCHEMA))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The rows, with their own columns, in which no item occurs."""
    schema = docs.schema
    for items in item_blocks(benchmark):
        index = Index(items, similarity)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, batch.schema.names.index(text), PART):
                    dirty = {i for i, *_ in index.find(texts)}
                    yield part.filter(pa.array([i not in dirty for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op7_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur in documents."""
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
