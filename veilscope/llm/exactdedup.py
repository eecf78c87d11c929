"""Exact dedup by a cuckoo-filter index over the digests of normalised texts.

A text's digest is the SHA-256 of its UTF-8 form without white space. ``CuckooIndex`` holds live digests: a filter of
16-bit fingerprints in two candidate buckets of four answers most look-ups of new digests, a hit is verified against
the content that is kept in stripes beside it, a digest can be deleted again, and when an insertion finds no place the
filter is doubled and filled anew from the stored keys.

Each partition first merges its own copies, so a group of any size leaves one row for each partition; then the digests
are dealt out by hash and each shard, sorted by digest, merges what is left. As soon as a shard holds ``LIVE_DIGESTS`` it hands
them on, since no later row can have one of them; so the index of any shard fits in a fixed space. Texts never move:
only digests, lengths and keys do.

Of equal texts the longest original stays (code points), then the smallest key, then the first row; a null key comes
last. Cases: null counts as empty, and all texts without other characters than white space are equal; repeated rows
are copies like any others, and one of them stays; an empty table gives an empty result; only the key and the text
are read, and further columns of any name come along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .shared import SPACE, by_name, checkpointed, free_name, numbered, stored

SLOTS, MAX_KICKS, STRIPES = 4, 200, 256
#: A task hands on what it has merged when it holds so many digests.
LIVE_DIGESTS = 300_000


class CuckooIndex:
    """Values by digest (at least 16 uniform bytes), found through a cuckoo filter.

    >>> index = CuckooIndex(8)
    >>> index.insert(b"0123456789abcdef", "value"); index.find(b"0123456789abcdef")
    'value'
    """

    def __init__(self, buckets: int = 1024):
        self.content: list[dict[bytes, object]] = [{} for _ in range(STRIPES)]
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = (1 << max(1, buckets - 1).bit_length()) - 1
        self.slots = [0] * (SLOTS * (self.mask + 1))

    def __len__(self) -> int:
        return sum(map(len, self.content))

    def items(self) -> Iterator[tuple[bytes, object]]:
        for stripe in self.content:
            yield from stripe.items()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def may_contain(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        s = self.slots
        return mark in s[a * SLOTS : a * SLOTS + SLOTS] or mark in s[b * SLOTS : b * SLOTS + SLOTS]

    def find(self, digest: bytes):
        """The value, after a hit of the filter was verified against the content; else None."""
        return self.content[digest[8]].get(digest) if self.may_contain(digest) else None

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        bucket = a
        for kick in range(MAX_KICKS):
            i = bucket * SLOTS + kick % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            bucket = self._other(bucket, mark)
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        return False

    def insert(self, digest: bytes, value: object) -> None:
        """Add a digest that is not live."""
        stripe = self.content[digest[8]]
        if digest in stripe:
            raise KeyError("live already")
        stripe[digest] = value
        if not self._place(digest):
            self._resize()

    def _resize(self) -> None:
        """Double the filter until every stored key has a place."""
        done = False
        while not done:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            done = all(self._place(digest) for digest, _ in self.items())

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        if self.find(digest) is None:
            return False
        del self.content[digest[8]][digest]
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        raise AssertionError("a live digest has no fingerprint")


def digests(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row") -> DataFrame:
    """``row``, ``key``, ``digest`` (32 bytes) and ``length`` (code points of the original) of each of the numbered
    ``rows``."""
    full = F.coalesce(by_name(text).cast("string"), F.lit(""))
    return rows.select(
        F.col(row).alias("row"),
        by_name(key).alias("key"),
        F.unhex(F.sha2(F.translate(full, SPACE, "").cast("binary"), 256)).alias("digest"),
        F.length(full).cast("long").alias("length"),
    )


def _merge(rows: DataFrame) -> DataFrame:
    """Merge rows of equal digests within each partition; if it is sorted by digest, into one row for each.

    A row with a negative size deletes its digest."""
    schema = pa.schema([("digest", pa.binary()), ("length", pa.int64()), ("key", to_arrow_type(rows.schema["key"].dataType)), ("row", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def leave() -> Iterator[pa.RecordBatch]:
            held = [(d, *v) for d, v in index.items()]
            for at in range(0, len(held), 10_000):
                columns = zip(*held[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for digest, length, key, row, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                old = index.find(digest)
                if old is None and len(index) >= LIVE_DIGESTS:
                    yield from leave()
                    index = CuckooIndex()
                if size < 0:
                    index.delete(digest)
                elif old is None:
                    index.insert(digest, (length, key, row, size))
                else:
                    new = min((length, key, row), old[:3], key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2]))
                    if new == old[:3]:
                        index.content[digest[8]][digest] = (*new, old[3] + size)
                    else:  # another row takes the place
                        index.delete(digest)
                        index.insert(digest, (*new, old[3] + size))
        yield from leave()

    return rows.select("digest", "length", "key", "row", "size").mapInArrow(run, from_arrow_schema(schema))


def build_index(rows: DataFrame) -> DataFrame:
    """The index table over rows of ``digests``: a row for each digest with the row that stays and the group's size."""
    return _merge(_merge(rows.withColumn("size", F.lit(1).cast("long"))).repartition("digest").sortWithinPartitions("digest"))


def update_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index after rows of ``digests`` were added and then digests removed; both may be left out."""
    rows = index if added is None else index.unionByName(build_index(added))
    if removed is not None:
        gone = removed.select("digest").distinct()
        rows = rows.unionByName(index.sparkSession.createDataFrame([], rows.schema).unionByName(gone.withColumn("size", F.lit(-1).cast("long")), allowMissingColumns=True))
    return _merge(rows.repartition("digest").sortWithinPartitions("digest", F.col("size") < 0))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: its key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    row = free_name(df, "row")
    rows = stored(digests(numbered(df, row), key, text, row), "digests")
    index = checkpointed(build_index(rows)).select("digest", F.col("key").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))
    return rows.join(index, "digest").select(
        F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    row = free_name(df, "row")
    rows = numbered(df, row)
    index = checkpointed(build_index(digests(rows, key, text, row)))
    return rows.join(index.select(F.col("row").alias(row)).hint("merge"), row, "left_semi").select(*map(by_name, df.columns))


DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
