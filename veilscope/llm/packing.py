"""Best-fit packing of tokenised documents into sequences, hierarchically by residual room.

Each partition tokenises its documents, cuts those that are longer than a sequence into pieces, and packs its pieces
best-fit, longest first. Nearly full bins are final. What is in all others goes up a tree as items: every ``FAN`` nodes
hand theirs to one node that packs them best-fit again and keeps the nearly full bins, until the root keeps all.
(Underfull bins are handed on as what they hold. Bins that stay together on their way up would waste the places that
their parts could fill: two pieces of 900 tokens can no longer join two of 1,100.)

Items of the same length are alike, so a node hands on how many items it has of each length and nothing else:
``capacity`` numbers at most, however many items. Its parent packs whole runs of equal items at once and writes down
which run went where. In the end each piece follows these notes from its partition to the root. So every underfull bin
takes part in every round, no node grows with the input, and neither texts nor ids nor pieces move.

Cases: a null or empty text is the end id alone; a text of any length is cut into whole sequences and a rest; equal
texts and repeated rows are packed one by one; an empty table gives an empty result; only the key and the text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema, to_arrow_type

from .shared import BlockFiles, by_name, stored
from .tokens import encoder

CAPACITY = 2048
#: Bins with so little room left are final.
SLACK = 8
FAN = 16
#: Pieces that a worker holds before it packs them.
PENDING = 400_000


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the fill of each bin; longest first, each into the fullest bin with room.

    Bins are kept on a stack for each residual room; a bit mask finds the smallest room that suffices."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if above := mask >> need:
            room = need + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        if room > need:
            rooms[room - need].append(b)
            mask |= 1 << (room - need)
    return bins, offsets, fills


@dataclass
class Run:
    """So many equal bins: their fill, and for each item in them its child, fill, first rank and offset."""

    fill: int
    count: int
    parts: list[tuple[int, int, int, int]]

    def split(self, n: int) -> Run:
        """Take the first ``n`` bins away."""
        first = Run(self.fill, n, self.parts)
        self.count, self.parts = self.count - n, [(child, fill, rank + n, offset) for child, fill, rank, offset in self.parts]
        return first

    def join(self, other: Run) -> None:
        """Put a bin of a run of the same length behind each bin."""
        self.parts = self.parts + [(child, fill, rank, offset + self.fill) for child, fill, rank, offset in other.parts]
        self.fill += other.fill


def merge_runs(runs: list[Run], capacity: int) -> list[Run]:
    """Best-fit of bins as items, fullest first; what single items would do, done for whole runs.

    A bin with room for several items of a run takes as many as it can, since it stays the fullest with room."""
    rooms: list[list[Run]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for run in sorted(runs, key=lambda r: -r.fill):
        need = run.fill
        while run.count:
            if above := mask >> need:
                room = need + (above & -above).bit_length() - 1
                stack = rooms[room]
                most, into = stack[-1].count, stack[-1]
            else:
                room, most, into = capacity, run.count, None
            times = min(room // need, run.count)
            n = min(most, run.count // times)
            if into is None:
                bins, times = run.split(n), times - 1
            elif n < most:
                bins = into.split(n)
            else:
                bins = stack.pop()
                if not stack:
                    mask ^= 1 << room
            for _ in range(times):
                bins.join(run.split(n))
            room = capacity - bins.fill
            rooms[room].append(bins)
            mask |= 1 << room
    return [run for stack in rooms for run in stack]


def _sequence_ids(level: int, node: int, fills: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Up to 2**24 partitions, of whose bins 2**23 have the same fill; a parent has ``FAN`` = 2**4 times as many."""
    return (np.int64(level) << 59) | (fills.astype(np.int64) << 47) | (np.int64(node) << (23 + 4 * level)) | ranks.astype(np.int64)


def _pack_partitions(df: DataFrame, path: str, byte_level: bool, end_id: int, capacity: int) -> DataFrame:
    """The pieces: their node (partition), ``fill``, ``rank`` and ``offset``. For pieces in final bins these are the bin's
    fill, its rank among the node's bins of that fill, and the place in it; others are items of their own, with their
    length and their rank among the node's items of that length."""
    schema = pa.schema([
        ("node", pa.int64()), ("fill", pa.int32()), ("rank", pa.int64()), ("key", to_arrow_type(df.schema["key"].dataType)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = encoder(path, byte_level).encode, TaskContext.get().partitionId()
        held, used = [], np.zeros(capacity + 1, np.int64)

        def pack() -> pa.RecordBatch:
            key, piece, start, length, crc = map(list, zip(*held, strict=True))
            bins, offsets, fills = best_fit(length, capacity)
            # A final bin is one thing to be ranked, with its first piece; so is each piece of the others.
            at, offset, length = np.array(bins), np.array(offsets), np.array(length)
            fill = np.array(fills)[at]
            final = fill >= capacity - SLACK
            fill, offset = np.where(final, fill, length), np.where(final, offset, 0)
            first = ~final | (offset == 0)
            ranked, by = fill[first], np.argsort(fill[first], kind="stable")
            counts = np.bincount(ranked, minlength=capacity + 1)
            ranks = np.empty(len(ranked), np.int64)
            ranks[by] = np.arange(len(ranked)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(used, counts)
            used[:] += counts
            of_bin = np.zeros(len(fills), np.int64)
            of_bin[at[first]] = ranks
            rank = of_bin[at]
            rank[first] = ranks
            held.clear()
            columns = [[node] * len(key), fill, rank, key, piece, start, length, crc, offset]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    held += [(key, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                if len(held) >= PENDING:
                    yield pack()
        if held:
            yield pack()

    return df.mapInArrow(run, from_arrow_schema(schema))


def _merge(handed: DataFrame, last: bool, capacity: int) -> DataFrame:
    """One level up, from ``node``, ``fill`` and ``n`` (items): where each run of items of a ``child`` went.

    ``n`` items of ``child`` and ``fill`` from rank ``first`` on are now, at ``offset``, in what ``node`` has of
    ``new_fill`` from rank ``new_first`` on: final bins, or items that it hands on."""
    names = ["node", "child", "fill", "first", "n", "offset", "new_fill", "new_first"]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(rows: pa.Table) -> pa.Table:
        node = rows["node"][0].as_py() // FAN
        runs = [Run(fill, n, [(child, fill, 0, 0)]) for child, fill, n in sorted(zip(*(rows[c].to_pylist() for c in ("node", "fill", "n")), strict=True))]
        out, used = [], [0] * (capacity + 1)
        for merged in merge_runs(runs, capacity):
            final = last or merged.fill >= capacity - SLACK
            for child, fill, first, offset in merged.parts:
                if final:
                    out.append((node, child, fill, first, merged.count, offset, merged.fill, used[merged.fill]))
                else:
                    out.append((node, child, fill, first, merged.count, 0, fill, used[fill]))
                    used[fill] += merged.count
            if final:
                used[merged.fill] += merged.count
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return handed.groupBy(F.expr(f"node div {FAN}")).applyInArrow(run, from_arrow_schema(schema))


def _placed(pieces: DataFrame, notes: BlockFiles, levels: int, capacity: int) -> DataFrame:
    """``pieces`` with the sequence and the offset that they have after all rounds."""
    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = to_arrow_schema(pieces.schema)
    schema = pa.schema([full.field(c) if c in full.names else pa.field(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            table = {c: batch.column(c).to_numpy() for c in ("node", "fill", "rank", "offset")}
            sequence, offset = np.zeros(batch.num_rows, np.int64), table["offset"].copy()
            for leaf in np.unique(table["node"]).tolist():
                at = np.flatnonzero(table["node"] == leaf)
                fill, rank, node = table["fill"][at].astype(np.int64), table["rank"][at].astype(np.int64), leaf
                for level in range(levels + 1):
                    done = (fill >= capacity - SLACK) | (level == levels)
                    sequence[at[done]] = _sequence_ids(level, node, fill[done], rank[done])
                    at, fill, rank = at[~done], fill[~done], rank[~done]
                    if not len(at):
                        break
                    if (level, node) not in known:
                        known = {k: v for k, v in known.items() if k[0] != level} | {(level, node): notes.read(level << 40 | node)}
                    run_key, first, add, new_fill, new_first = known[level, node]
                    where = np.searchsorted(run_key, fill << 47 | rank, "right") - 1
                    rank = new_first[where] + rank - first[where]
                    offset[at] += add[where]
                    fill, node = new_fill[where], node // FAN
            columns = [batch.column(c) if c in full.names and c != "offset" else pa.array(sequence if c == "sequence_id" else offset) for c in names]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pieces.mapInArrow(run, from_arrow_schema(schema))


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", byte_level: bool = False, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    rows = df.select(by_name(key).alias("key"), by_name(text).cast("string").alias("text"))
    pieces = stored(_pack_partitions(rows, path, byte_level, end_id, capacity), "pieces")
    still_open = f"fill < {capacity - SLACK}"
    handed = stored(pieces.where(still_open).groupBy("node", F.col("fill").cast("long").alias("fill")).agg((F.max("rank") + 1).alias("n")), "fills")
    top, levels, notes = pieces.agg(F.max("node")).first()[0] or 0, 0, None
    while levels == 0 or top:
        level = stored(_merge(handed, top < FAN, capacity), "notes")
        own = level.select(
            ((F.lit(levels).cast("long") * 2**40) + F.col("child")).alias("block"), F.expr("shiftleft(fill, 47) | first").alias("run_key"), "first", "offset", "new_fill", "new_first"
        )
        notes = own if notes is None else notes.unionByName(own)
        handed = level.where(f"new_{still_open}").groupBy("node", F.col("new_fill").alias("fill")).agg(F.max(F.col("new_first") + F.col("n")).alias("n"))
        top, levels = top // FAN, levels + 1
    return _placed(pieces, BlockFiles(notes, "notes"), levels, capacity).withColumnRenamed("key", key)
