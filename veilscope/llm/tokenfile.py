"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, the next level the
second chunk of those that have one, and so on; a bitmap for each level marks the ids that continue, and a rank
directory counts the marks before each block of 512 bits. So ``ids[i]`` takes one look-up a level: no block is decoded.

A file holds whole documents in ascending key order with a directory of their starts, and names in its head where each
part of each level begins. So ``TokenReader`` fetches one id by reading a few bytes a level, wherever it is in a file of
any size. Executors write the files into
the shared folder under names that no other attempt uses, and return a row for each; only files named by these rows
count, so a lost executor or a repeated task leaves nothing but an unread file.

Cases: a null or empty text is the end id alone; null keys come first; rows with equal keys keep their own entries,
ordered by text; a text of any length is written whole, in a file of its own if it is very long; an empty table gives
no files and an empty result; only the key and the text are read, so further columns cannot clash. Keys are integers;
keys of any other type are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegralType

from .shared import checkpointed, fresh_path
from .tokens import encoder

MAGIC = b"VDAC0002"
WIDTH = 8
RANK_BLOCK = 512
#: A file is closed when it holds so many ids.
FILE_IDS = 2_000_000
_HEAD = struct.Struct("<8sQQI")


class DirectCodes:
    """Ids as chunk levels with continuation bitmaps and rank directories."""

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        levels, bitmaps, ranks = [], [], []
        rest = np.asarray(ids, np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8))
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8)])
            counts = np.bitwise_count(bits).reshape(-1, RANK_BLOCK // 8).sum(1, dtype=np.uint32)
            bitmaps.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)]).astype(np.uint32))
            rest = rest[more] >> WIDTH
            if not len(rest):
                return cls(levels, bitmaps, ranks)

    def __len__(self) -> int:
        return len(self.levels[0])

    def _rank(self, level: int, at: int) -> int:
        """Marks before position ``at``."""
        block, bit = divmod(at, RANK_BLOCK)
        first, bits = block * RANK_BLOCK // 8, self.bitmaps[level]
        full, left = divmod(bit, 8)
        count = int(self.ranks[level][block]) + int(np.bitwise_count(bits[first : first + full]).sum())
        return count + ((int(bits[first + full]) & ((1 << left) - 1)).bit_count() if left else 0)

    def __getitem__(self, at: int) -> int:
        """One id, by one look-up a level."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[at]) << (WIDTH * level)
            if not self.bitmaps[level][at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return value

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids of a range."""
        out = np.zeros(end - begin, np.uint32)
        where = slice(None)
        for level, chunks in enumerate(self.levels):
            out[where] |= chunks[begin:end].astype(np.uint32) << np.uint32(WIDTH * level)
            first = begin >> 3
            marks = np.unpackbits(self.bitmaps[level][first : (end + 7) >> 3], bitorder="little")[begin - 8 * first : end - 8 * first].astype(bool)
            if not marks.any():
                break
            where = (np.arange(end - begin) if level == 0 else where)[marks]
            begin, end = self._rank(level, begin), self._rank(level, end)
        return out


def write_file(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes: the head with the places of all parts, keys with their null marks, lengths, then for each level
    chunks, bitmap and ranks."""
    codes = DirectCodes.of(ids)
    parts = [np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), np.array(lengths, "<u8").tobytes()]
    for level in zip(codes.levels, codes.bitmaps, codes.ranks, strict=True):
        parts += [level[0].tobytes(), level[1].tobytes(), level[2].astype("<u4").tobytes()]
    places, at = [], _HEAD.size + 8 * (len(parts) + 1)
    for part in parts:
        places.append(at)
        at += len(part)
    return b"".join([_HEAD.pack(MAGIC, len(keys), len(ids), len(codes.levels)), np.array([*places, at], "<u8").tobytes(), *parts])


def _head(data: bytes) -> tuple[int, int, int]:
    """Numbers of documents, ids and levels."""
    magic, n, n_ids, levels = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    return n, n_ids, levels


class TokenReader:
    """Single ids of a file that is open, each by a few short reads and without any of the rest."""

    def __init__(self, file):
        self.file = file
        self.n_documents, self.n_ids, self.n_levels = _head(self._read(0, _HEAD.size))
        self.places = np.frombuffer(self._read(_HEAD.size, 8 * (3 * self.n_levels + 4)), "<u8").tolist()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = 0
        for level in range(self.n_levels):
            chunks, bitmap, ranks = self.places[3 + 3 * level : 6 + 3 * level]
            value |= self._read(chunks + at, 1)[0] << (WIDTH * level)
            block, bit = divmod(at, RANK_BLOCK)
            marks = int.from_bytes(self._read(bitmap + block * RANK_BLOCK // 8, RANK_BLOCK // 8), "little")
            if not marks >> bit & 1:
                break
            at = int.from_bytes(self._read(ranks + 4 * block, 4), "little") + (marks & ((1 << bit) - 1)).bit_count()
        return value


class TokenFile:
    """A file that was read: keys, the place of each document, and its codes."""

    def __init__(self, data: bytes):
        n, self.n_ids, levels = _head(data)
        places = np.frombuffer(data, "<u8", 3 * levels + 4, _HEAD.size).tolist()
        parts = [np.frombuffer(data, kind, (end - at) // np.dtype(kind).itemsize, at) for kind, at, end in zip(["<i8", "u1", "<u8", *["u1", "u1", "<u4"] * levels], places, places[1:], strict=False)]
        self.keys = [None if z else int(k) for k, z in zip(parts[0], parts[1], strict=True)]
        self.lengths = parts[2].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = DirectCodes(parts[3::3], parts[4::3], parts[5::3])

    def document(self, i: int) -> np.ndarray:
        return self.codes.span(int(self.starts[i]), int(self.starts[i] + self.lengths[i]))


MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())])
ENTRY = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_files(df: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write the files below ``folder`` (a path or URI that all executors reach); one row for each file."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"keys must be integers, {key} is {df.schema[key].dataType.simpleString()}")
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    by = [F.col("key"), F.xxhash64("text")]
    ranged = (rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)).sortWithinPartitions(*by, "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, True).encode, TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        keys: list[int | None] = []
        ids: list[bytes] = []
        number = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            path = f"{root}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            flat = np.frombuffer(b"".join(ids), "<u4")
            with store.open_output_stream(path) as out:
                out.write(write_file(keys, [len(x) // 4 for x in ids], flat))
            row = [[part], [number], [path], [len(keys)], [len(flat)]]
            number += 1
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, MANIFEST, strict=True)], schema=MANIFEST)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part_of = batch.slice(at, 256)
                keys += part_of.column(0).to_pylist()
                new = [x + end for x in encode(part_of.column(1).to_pylist())]
                ids += new
                held += sum(map(len, new)) // 4
                if held >= FILE_IDS:
                    yield close()
                    held = 0
        if keys:
            yield close()

    return checkpointed(ranged.mapInArrow(run, from_arrow_schema(MANIFEST)))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the files, in terms of the whole corpus; ``start`` counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    file = TokenFile(f.read())
                ids, ends = file.codes.span(0, file.n_ids).astype("<u4"), file.starts + file.lengths
                crcs = [zlib.crc32(ids[begin:end].data) for begin, end in zip(file.starts.tolist(), ends.tolist(), strict=True)]
                columns = [file.keys, file.starts + row["file_start"], file.lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)

    files = max(1, min(10_000, manifest.count()))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each partition of the shuffle
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    placed = manifest.select("part", "path", before(Window.partitionBy("part").orderBy("number")).alias("in_part")).join(parts, "part").select("path", (F.col("part_start") + F.col("in_part")).alias("file_start"))
    return placed.repartition(files).mapInArrow(run, from_arrow_schema(ENTRY))


def token_table(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into the shared folder and return what they hold."""
    folder = fresh_path(df.sparkSession, "tokens")
    return read_files(write_files(df, folder, vocabulary, key, text), folder).withColumnRenamed("key", key)
