"""Near dedup by ProbMinHash: shingles, banding, verification, connected classes.

Words are runs of word characters in lower case, shingles five words (a shorter text is one shingle). A distinct shingle
has the weight 1 however often it occurs, so that the sketches estimate what links are made by. Each shingle is a
Poisson process whose rate is its weight; every arrival falls into one of ``REGISTERS`` registers, and a register keeps
the shingle that arrived first. Two texts agree in a register with the probability Jaccard similarity of their shingles,
here the Jaccard similarity of the sets. A text is done as soon as no arrival can come before the latest first one:
arrivals are generated up to a time limit that holds for all registers, which is raised in the rare case that one is
still empty. The work for a text is then about ``m log m`` arrivals, however long it is.

``BANDS`` bands of ``ROWS`` registers make the buckets. Two texts are linked if the Jaccard similarity of their shingle
sets is ``LINK`` or more; at that similarity a pair shares no bucket with a probability below 1e-5. A class is a
connected component of links; equal word sequences are one node from the start, so copies are never paired.

Pairs of a bucket are never made. A bucket's hub is the member that shares most buckets with others, and

1. each node is verified against one hub, the best known of its buckets', and linked nodes are contracted;
2. each node is verified against those hubs of its buckets that are in another component, and again contracted;
3. where the other members of a hub's buckets are still in several components, they are dealt out to blocks, and a task
   compares the exact shingle sets of its block by a matrix product. It returns links only, and no more than join its
   components;
4. after another contraction, what is outside a hub's largest component goes in the same way to all of its blocks.

So candidates and links are in proportion to the nodes, members of one component are not compared again, and every pair
of nodes in different components that share a bucket has been compared exactly: no link is lost. What the last step
computes, though it makes no rows, is a hub's members times those that it could not link.

Joins that move texts or sets are merge joins at every size, so that their cost follows the input.

Cases: a null text counts as empty, texts without words are equal to one another; a class's id is its smallest key, a
null key comes last and identifies a class only where all its keys are null; repeated rows are copies; an empty table
gives an empty result; only key and text are read, and further columns of any name come along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .shared import by_name, checkpointed, free_name, numbered, stored

WORDS, LINK = 5, 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Nodes and bytes of shingles in a block of those that a hub has not linked, and in one of all its members.
OPEN_BLOCK, BLOCK, BLOCK_BYTES = 256, 512, 2**25
#: Shingles that are compared at once.
COLUMNS = 4096
#: A task remembers so many digests to leave out repeated signatures.
REMEMBER = 500_000
_MULT, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


@lru_cache(1)
def _word_table() -> np.ndarray:
    """Which code points are word characters; those beyond the table are."""
    return np.array([chr(i).isalnum() for i in range(65_536)] + [True])


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> tuple[np.ndarray, bytes]:
    """A hash for each word, and the digest of the word sequence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64), hashlib.blake2b(b"", digest_size=16).digest()
    inner = _word_table()[np.minimum(points, 65_536)]
    edge = np.diff(inner.astype(np.int8), prepend=0)
    first = np.flatnonzero(edge == 1)
    keep = inner | (edge == -1)
    if len(first):
        keep[: first[0]] = False
    flat = np.where(inner, points, 32)[keep]
    if len(flat) and flat[-1] == 32:
        flat = flat[:-1]
    digest = hashlib.blake2b(flat.astype("<u4").tobytes(), digest_size=16).digest()
    if not len(first):
        return np.zeros(0, np.uint64), digest
    word = np.cumsum(edge == 1) - 1
    with np.errstate(over="ignore"):
        place = (np.arange(len(points)) - first[np.maximum(word, 0)]).astype(np.uint64)
        part = np.where(inner, _mixed(points.astype(np.uint64) * _MULT + place * _BASE), np.uint64(0))
        return _mixed(np.add.reduceat(part, first)), digest


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their frequencies."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    size = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        code = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            code = code * _BASE + words[k : len(words) - size + 1 + k]
        if size < WORDS:
            code = code + np.uint64(size) * _MULT
    return np.unique(_mixed(code), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element that arrives first in each register (64 bits); elements are uniform 64-bit hashes."""
    if not len(elements):
        return np.zeros(registers, np.uint64)
    limit = registers * (np.log(registers) + 4) / weights.sum()
    while True:
        mean = limit * weights
        depth = int((mean + 6 * np.sqrt(mean)).max()) + 12
        found = _arrivals(elements, weights, limit, depth, registers)
        if found is not None:
            return found
        limit *= 2


def _arrivals(elements: np.ndarray, weights: np.ndarray, limit: float, depth: int, registers: int) -> np.ndarray | None:
    """First arrivals if all come before ``limit``. The r-th arrival of an element depends on element and r alone."""
    first, winner = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    times, rank, active, w = np.zeros(len(elements)), 0, elements, weights
    while len(active):
        # One arrival for all at first, as most elements of a long text have none before the limit.
        steps = np.arange(rank + 1, rank + (2 if rank == 0 else depth + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            bits = _mixed(active[:, None] + steps[None, :] * _MULT)
        when = times[:, None] - np.cumsum(np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52), 1) / w[:, None]
        row, column = np.nonzero(when < limit)
        t = when[row, column]
        register = ((bits[row, column] & np.uint64(0xFFF)) * np.uint64(registers) >> np.uint64(12)).astype(np.int64)
        late = np.argsort(-t)  # the earliest is written last
        t, register, element = t[late], register[late], active[row[late]]
        sooner = t < first[register]
        first[register[sooner]], winner[register[sooner]] = t[sooner], element[sooner]
        on = when[:, -1] < limit
        times, active, w, rank = when[on, -1], active[on], w[on], int(steps[-1])
    return winner if np.isfinite(first).all() else None


def buckets(registers: np.ndarray) -> np.ndarray:
    """A 63-bit bucket for each band of a signature of 16-bit registers."""
    with np.errstate(over="ignore"):
        code = np.zeros(BANDS, np.uint64)
        for k in range(ROWS):
            code = code * _BASE + registers[k::ROWS].astype(np.uint64) + np.uint64(1)
        return (_mixed(code * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """``row``, ``key``, ``digest`` and ``sig``, which is null where the task has sketched an equal text before."""
    schema = pa.schema([("row", pa.int64()), ("key", to_arrow_type(rows.schema["key"].dataType)), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, sigs = [], []
                for t in part.column(2).to_pylist():
                    words, digest = word_hashes(t or "")
                    digests.append(digest)
                    if digest in met:
                        sigs.append(None)
                        continue
                    if len(met) < REMEMBER:
                        met.add(digest)
                    elements, _ = shingles(words)
                    sigs.append((signature(elements, np.ones(len(elements))) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return rows.mapInArrow(run, from_arrow_schema(schema))


def _banded(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.frombuffer(s, "<u2") for s in batch.column(1).to_pylist()]
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([buckets(s) for s in sigs])), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], schema=schema)

    return nodes.select("node", "sig").mapInArrow(run, from_arrow_schema(schema))


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and its sorted distinct ``shingles`` (64 bits each), from the texts themselves."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(word_hashes(t or "")[0])[0].astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return rows.select(F.col("row").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi").mapInArrow(run, from_arrow_schema(schema))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of LINK or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                left, right = left.as_py(), right.as_py()
                n, m = len(left) // 8, len(right) // 8
                if min(n, m) < LINK * max(n, m):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(same >= LINK * (n + m - same) and n + m > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return with_sets.select("a", "b", "left", "right").mapInArrow(run, from_arrow_schema(schema))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, of each node of ``links``, by contraction.

    Every node takes the smallest of itself and its neighbours as its parent, parents are replaced by their parents,
    and the links are drawn anew between what is left; those within one node vanish. So the links shrink in each round,
    and a star, the usual shape of near copies, is gone after two."""
    edges = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    placed = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
        parents = checkpointed(ends.groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("_least")).select("x", F.least("x", "_least").alias("up")))
        for _ in range(2):
            above = parents.select(F.col("x").alias("up"), F.col("up").alias("_next"))
            parents = parents.join(above, "up").select("x", F.col("_next").alias("up"))
        parents = checkpointed(parents)
        if placed is None:
            placed = parents.select(F.col("x").alias("node"), F.col("up").alias("component"))
        else:
            step = parents.select(F.col("x").alias("component"), F.col("up").alias("_up"))
            placed = checkpointed(placed.join(step, "component", "left").select("node", F.coalesce("_up", "component").alias("component")))
        left = edges.join(parents.select(F.col("x").alias("a"), F.col("up").alias("_a")), "a").join(parents.select(F.col("x").alias("b"), F.col("up").alias("_b")), "b")
        edges = checkpointed(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct())
        if edges.isEmpty():
            return placed


def _contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (``node``, ``component``) after its components, and nodes outside it, are joined by further links."""
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    across = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(checkpointed(across))
    moved = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_joined")), "component", "left").select("node", F.coalesce("_joined", "component").alias("component"))
    return checkpointed(moved.unionByName(joined.join(found.select("node"), "node", "left_anti").select("node", "component")))


def _common(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many elements each of the first ``n`` sets shares with each of the others, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    met = often[column]
    owner, column = owner[met], place[column[met]]
    out = np.zeros((n, len(sets) - n), np.float64)
    for at in range(0, int(often.sum()), COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[some], column[some] - at] = 1
        out += dense[:n] @ dense[n:].T
    return out


def _block_links(members: DataFrame, own: bool = False) -> DataFrame:
    """Links (a, b) between members of a ``hub`` in different components: a forest of them for each pair of blocks.

    With ``own`` a member is only compared with those of its own block."""
    parts = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("size"))
    hubs = parts.groupBy("hub").agg(F.max(F.struct("n", "component", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, size, most: F.ceil(F.greatest(n / most, size / BLOCK_BYTES)).cast("int")
    hubs = hubs.select(
        "hub", F.col("most.component").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"), OPEN_BLOCK).alias("opens"), blocks(F.col("n"), F.col("size"), BLOCK).alias("alls")
    )
    dealt = members.join(stored(hubs, "hubs"), "hub").withColumn("open", F.col("component") != F.col("main"))  # stored, so that a hot hub can be split in the join
    mine = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["hub", "x", "y", "side", "node", "component", "shingles"]
    left = dealt.where("open").withColumn("x", F.lit(0) if own else mine("opens")).withColumn("y", mine("alls") if own else every("alls")).withColumn("side", F.lit(0)).select(columns)
    right = dealt.withColumn("y", mine("alls")).withColumn("x", F.lit(0) if own else every("opens")).withColumn("side", F.lit(1)).select(columns)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        by, n = np.argsort(side, kind="stable"), int((side == 0).sum())
        node, component = table["node"].to_numpy()[by], table["component"].to_numpy()[by]
        held = table["shingles"].to_pylist()
        sets = [np.frombuffer(held[i], "<u8") for i in by]
        sizes = np.array([len(x) for x in sets])
        out, parent = [], {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        if 0 < n < len(sets):
            both = _common(sets, n)
            linked = (both >= LINK * (sizes[:n, None] + sizes[None, n:] - both)) & (component[:n, None] != component[None, n:])
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = root(component[i]), root(component[n + j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((node[i], node[n + j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    blocked = left.unionByName(right).repartition("hub", "x", "y")  # else all blocks of a hub stay in one task
    return blocked.groupBy("hub", "x", "y").applyInArrow(run, from_arrow_schema(schema)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_hubs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (``hub``, ``node``) that share a bucket whose hub is the first, and each node's ``best`` hub."""
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    hubs = members.join(fame, "node").groupBy("bucket").agg(F.max(F.struct("fame", -F.col("node"))).alias("_top"))
    hubs = stored(hubs.select("bucket", (-F.col("_top")["col2"]).alias("hub"), F.col("_top.fame").alias("fame")), "hubs")
    spokes = stored(members.join(hubs, "bucket").where("hub <> node").groupBy("hub", "node").agg(F.max("fame").alias("fame")), "spokes")
    best = spokes.groupBy("node").agg(F.max(F.struct("fame", -F.col("hub"))).alias("_top")).select("node", (-F.col("_top")["col2"]).alias("hub"))
    return spokes.select("hub", "node"), best


def classes(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row") -> DataFrame:
    """``row``, ``key`` and ``class`` (the smallest row of a text of its class) of each row of ``rows``, which are
    ``numbered``."""
    rows = rows.select(F.col(row).alias("row"), by_name(key).alias("key"), by_name(text).cast("string").alias("text"))
    sketched = stored(sketches(rows), "sketches")
    nodes = stored(sketched.groupBy("digest").agg(F.min(F.when(F.col("sig").isNotNull(), F.col("row"))).alias("node")), "nodes")
    signed = sketched.where("sig is not null").select(F.col("row").alias("node"), "sig").join(nodes.select("node").hint("merge"), "node", "left_semi")
    banded = stored(_banded(signed), "bands")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(banded.join(shared.hint("merge"), "bucket"), "members")
    sets = stored(_texts_of(rows, members.select("node").distinct()), "shingles")
    spokes, best = _by_hubs(members)
    tried = checkpointed(best.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    found = components(checkpointed(_verified(tried, sets)))
    place = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    named = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = spokes.join(named("node"), "node", "left").join(named("hub"), "hub", "left").where(place("node") != place("hub"))
    more = checkpointed(apart.select(F.col("node").alias("a"), F.col("hub").alias("b")).join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = _contracted(found, _verified(more, sets))
    for own in (True, False):
        placed = checkpointed(spokes.join(named("node"), "node", "left").select("hub", "node", place("node").alias("component")))
        open_hubs = placed.groupBy("hub").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("hub")
        rest = checkpointed(placed.join(stored(open_hubs, "hubs"), "hub", "left_semi"))
        if rest.isEmpty():
            break
        found = _contracted(found, _block_links(stored(rest.join(sets, "node"), "open"), own))
    resolved = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    return sketched.select("row", "key", "digest").join(resolved, "digest").select("row", "key", "class")


def _stays(placed: DataFrame) -> DataFrame:
    """For each class its first key and row, nulls last, and its size."""
    return placed.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("_null"), "key", "row")).alias("_first"), F.count(F.lit(1)).alias("class_size"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``class_id`` (the smallest key of its class), ``class_size`` and ``kept`` of each row."""
    row = free_name(df, "row")
    placed = stored(classes(numbered(df, row), key, text, row), "classes")
    out = placed.join(stored(_stays(placed), "stays"), "class")  # stored, so that a hot class can be split in the join
    return out.select(F.col("key").alias(key), F.col("_first.key").alias("class_id"), "class_size", (F.col("row") == F.col("_first.row")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``df``, with all its columns."""
    row = free_name(df, "row")
    rows = numbered(df, row)
    stay = checkpointed(_stays(classes(rows, key, text, row)).select(F.col("_first.row").alias(row)))
    return rows.join(stay.hint("merge"), row, "left_semi").select(*map(by_name, df.columns))
