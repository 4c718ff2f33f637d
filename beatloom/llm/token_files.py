"""Corpora of token ids as binary files, in ascending document order.

Documents are dealt by range of doc_id; a task encodes its range and writes one file: groups of coded
blocks (see ``simple8b``), then a block table with byte offsets, a document table and a footer. The manifest
has one row per file; the starts of files are running sums over it. Reading decodes one group at a time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.llm import simple8b
from beatloom.llm.staging import filesystem, spread, stage
from beatloom.llm.tokens import encoder, slices
from beatloom.session import work_dir

MAGIC = b"s8bids01"
GROUP = 1024  # blocks that are coded and decoded together
DOC_DTYPE = np.dtype([("doc_id", "<i8"), ("ids", "<u8"), ("known", "u1")])
FOOTER_DTYPE = np.dtype([("blocks", "<u8"), ("documents", "<u8"), ("tables_at", "<u8")])


class IdWriter:
    """Writes one file of documents."""

    def __init__(self, folder: str) -> None:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.s8b"
        self.file = system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.at = self.waiting = self.total = 0
        self.parts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, len(ids), doc_id is not None))
        self.parts.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= GROUP * simple8b.BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids, size = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32), GROUP * simple8b.BLOCK
        for at in range(0, len(ids) if last else len(ids) - size + 1, size):
            words, exceptions, table = simple8b.encode(ids[at : at + size])
            table["word_at"] = table["word_at"] * 8 + self.at
            table["exception_at"] = table["exception_at"] * 4 + self.at + words.nbytes
            self.file.write(words.tobytes())
            self.file.write(exceptions.tobytes())
            self.at += words.nbytes + exceptions.nbytes
            self.tables.append(table)
        rest = ids[len(ids) // size * size :]
        self.parts, self.waiting = ([] if last else [rest]), len(rest)

    def close(self) -> tuple[str, int, int]:
        """Name, number of documents and number of ids."""
        self._flush(last=True)
        table = np.concatenate(self.tables) if self.tables else np.zeros(0, simple8b.BLOCK_DTYPE)
        self.file.write(table.tobytes())
        self.file.write(np.array(self.docs, DOC_DTYPE).tobytes())
        self.file.write(np.array([(len(table), len(self.docs), self.at)], FOOTER_DTYPE).tobytes() + MAGIC)
        self.file.close()
        return self.name, len(self.docs), self.total


class IdReader:
    """Reads a file group by group, or any blocks through the block table."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        tail = FOOTER_DTYPE.itemsize + len(MAGIC)
        end = self.file.read_at(tail, self.file.size() - tail)
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        foot = np.frombuffer(end[: -len(MAGIC)], FOOTER_DTYPE)[0]
        blocks, docs, at = int(foot["blocks"]), int(foot["documents"]), int(foot["tables_at"])
        size = blocks * simple8b.BLOCK_DTYPE.itemsize
        self.blocks = np.frombuffer(self.file.read_at(size, at), simple8b.BLOCK_DTYPE)
        self.docs = np.frombuffer(self.file.read_at(docs * DOC_DTYPE.itemsize, at + size), DOC_DTYPE)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1, which lie in one group."""
        table = self.blocks[first:last]
        words = self.file.read_at(8 * int(table["words"].sum()), int(table["word_at"][0]))
        exceptions = self.file.read_at(4 * int(table["exceptions"].sum()), int(table["exception_at"][0]))
        return simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(exceptions, "<u4"), table)

    def groups(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.blocks), GROUP):
            yield self.read(at, min(at + GROUP, len(self.blocks)))

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, number of ids and the ids in parts, in file order."""
        groups, have, at = self.groups(), np.zeros(0, np.uint32), 0
        for doc_id, n, known in self.docs:
            parts, left = [], int(n)
            while left:
                if at == len(have):
                    have, at = next(groups), 0
                parts.append(have[at : at + left])
                at += len(parts[-1])
                left -= len(parts[-1])
            yield int(doc_id) if known else None, int(n), iter(parts)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write files below ``folder``; returns the manifest.

    Manifest: shard (files in ascending document order), file, documents, ids, start (ids in all files
    before). Null texts are empty; null doc_ids come first; equal doc_ids are ordered by a hash of their text.
    Files have fresh names, and the manifest names only those of committed tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer, spaced), None
        for batch in batches:
            for part, texts in slices(batch, 1):
                out = out or IdWriter(folder)
                for key, ids in zip(part.column(0).to_pylist(), encode.encode(texts), strict=True):
                    out.add(key, np.append(np.frombuffer(ids, encode.dtype).astype(np.uint32), np.uint32(end_id)))
        if out:
            name, n, total = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [f"{folder}/{name}"], "documents": [n], "ids": [total]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = stage(dealt.mapInArrow(write, "shard long, file string, documents long, ids long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc_id, n, parts in IdReader(uri).documents():
                    crc = 0
                    for ids in parts:
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    rows.append((doc_id, start, n, crc))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = spread(manifest.select("file", "start"), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents and read the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_ids(docs, work_dir(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=2)
    return read_ids(manifest)
