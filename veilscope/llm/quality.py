"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols are UTF-16 code units, so every script has its own and an n-gram of ``ORDER`` = 4 is one 64-bit number; U+FFFF,
which is no character, stands for the borders of a text.

1. Documents form blocks by their place in their files. Each task counts the n-grams of a block at once, in all its
   documents and in the trusted ones that are not held out: a row for each n-gram of a block, not of a document.
2. The trusted counts, summed by n-gram, are the model's counts; lower orders use continuation counts, discounts come
   from the counts of counts of each order.
3. The probability of every n-gram that any document has follows from joins of the count tables, sharded by n-gram,
   context and suffix, from the lowest order up.
4. Joined back with the blocks' n-grams, each block's probabilities are written as files sorted by block. A task that
   reads a block's documents again looks its n-grams up there, and so has each document's perplexity.

Texts are never shuffled, nothing is broadcast, and neither the model nor the alphabet has a limit; what a task holds is
the n-grams of a block (``BLOCK_ROWS`` documents).

A document's score is its log perplexity per symbol, less ``ROOM`` over the root of its length, as short texts scatter
more. A language's threshold is the ``QUANTILE`` quantile of the scores of trusted documents that were held out of the
counts (a quarter, by a hash of the key), plus ``SLACK``; languages with fewer than ``LEAST_CALIBRATION`` such documents
use the threshold of all.

Cases: null, empty and blank texts have no score and are rejected; a null language uses the threshold of all; repeated
rows are scored alike; a text of any length is scored as one sequence, read in windows that carry their context; a
character that trusted text lacks has what its context leaves to the uniform distribution; without trusted text every
document with a text is kept; an empty table gives an empty result; further columns of any name come along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema, to_arrow_type

from .shared import BlockFiles, by_name, free_name, numbered, stored

ORDER = 4
QUANTILE, SLACK, ROOM = 0.99, 0.03, 3.0
LEAST_CALIBRATION = 30
#: Documents of a block: two to the power of this.
BLOCK_BITS = 13
#: Symbols whose n-grams are sorted at once, and n-grams of a block that a task holds before it hands them on.
AT_ONCE, MOST_HELD = 2_000_000, 8_000_000
#: Bits of a symbol, and the symbol before and after a text.
_BITS, _BORDER = 16, 0xFFFF
_WINDOW = 1_000_000


def _codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the n-grams that end at each symbol of a text and at its end, the first symbol most significant."""
    for at in range(0, len(text), _WINDOW):
        before = text[max(0, at - ORDER + 1) : at].encode("utf-16-le", "surrogatepass")[-2 * (ORDER - 1) :]
        units = np.frombuffer(before + text[at : at + _WINDOW].encode("utf-16-le", "surrogatepass"), "<u2")
        lead = ORDER - 1 - len(before) // 2
        symbols = np.full(lead + len(units) + (at + _WINDOW >= len(text)), _BORDER, np.uint64)
        symbols[lead : lead + len(units)] = units
        n = len(symbols) - ORDER + 1
        code = np.zeros(n, np.uint64)
        for k in range(ORDER):
            code = code << np.uint64(_BITS) | symbols[k : k + n]
        yield code.view(np.int64)


def _blank(text: str | None) -> bool:
    return not text or not text.strip()


def _flags(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``block``, ``row`` and ``fold`` (0: held out) of the trusted documents among the numbered ``rows``."""
    trusted = labels.where((F.col(label) == 1) & by_name(key).isNotNull()).select(by_name(key).cast(rows.schema[key].dataType).alias("key")).distinct()
    marked = rows.select("row", by_name(key).alias("key")).join(trusted.hint("merge"), "key")
    return marked.select(F.expr(f"shiftright(row, {BLOCK_BITS})").alias("block"), "row", F.pmod(F.xxhash64("key", F.lit(17)), F.lit(4)).cast("long").alias("fold"))


class _ByBlock:
    """The rows of one block file after the other, as the blocks come."""

    def __init__(self, files: BlockFiles):
        self.files, self.block, self.columns = files, None, []

    def of(self, block: int) -> list[np.ndarray]:
        if block != self.block:
            self.block, self.columns = block, self.files.read(block)
        return self.columns


def _folds(flags: _ByBlock, row: int) -> int:
    """The fold of a row, -1 if it is not trusted."""
    rows, folds = flags.of(row >> BLOCK_BITS)
    at = np.searchsorted(rows, row)
    return int(folds[at]) if at < len(rows) and rows[at] == row else -1


class _Grams:
    """Distinct n-grams of a block, with their number in the texts that count."""

    def __init__(self):
        self.codes, self.counts, self.fresh, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), {True: [], False: []}, 0

    def add(self, code: np.ndarray, counted: bool) -> None:
        self.fresh[counted].append(code)
        self.size += len(code)
        if self.size >= AT_ONCE:
            self.merge()

    def merge(self) -> None:
        codes, counts = [self.codes], [self.counts]
        for counted, fresh in self.fresh.items():
            if fresh:
                found, times = np.unique(np.concatenate(fresh), return_counts=True)
                codes.append(found)
                counts.append(times if counted else np.zeros(len(found), np.int64))
        self.codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate(counts), len(self.codes)).astype(np.int64)
        self.fresh, self.size = {True: [], False: []}, 0


def count(rows: DataFrame, flags: BlockFiles) -> DataFrame:
    """``block``, ``gram`` and ``n``: the n-grams of each block, and how often counted documents have them."""
    schema = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted, block, held = _ByBlock(flags), None, _Grams()

        def leave() -> Iterator[pa.RecordBatch]:
            held.merge()
            for at in range(0, len(held.codes), 100_000):
                codes = held.codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(held.counts[at : at + 100_000])], schema=schema)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row >> BLOCK_BITS != block or len(held.codes) > MOST_HELD:
                    if block is not None:
                        yield from leave()
                    block, held = row >> BLOCK_BITS, _Grams()
                text = text.as_py()
                if not _blank(text):
                    counted = _folds(trusted, row) > 0
                    for code in _codes(text):
                        held.add(code, counted)
        if block is not None:
            yield from leave()

    return rows.select("row", "text").mapInArrow(run, from_arrow_schema(schema))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    n = {r["n"]: r["c"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def _suffix(order: int) -> str:
    """A gram's last ``order`` symbols, as SQL."""
    return f"gram & {(1 << _BITS * order) - 1}L"


def probabilities(grams: DataFrame) -> DataFrame:
    """``gram`` and ``logp``, the log probability of its last symbol after the others, of each row of ``grams`` (``gram``
    and ``n``, how often it was counted).

    The tables are sharded by n-gram, by context and by suffix. An n-gram that was not counted has the probability of
    its suffix times what its context leaves to lower orders, all of it if the context was not counted either."""
    asked, seen = {ORDER: grams.select("gram")}, {ORDER: grams.where("n > 0")}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.expr(_suffix(order)).alias("gram")
        asked[order] = stored(asked[order + 1].select(suffix).distinct(), "asked")
        # Continuation counts: in how many ways an n-gram can be begun.
        seen[order] = stored(seen[order + 1].groupBy(suffix).agg(F.count(F.lit(1)).alias("n")), "seen")
    symbols = seen[1].count() + 1  # and one that was never seen
    lower = None
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(seen[order])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.expr(f"shiftrightunsigned(gram, {_BITS})").alias("context")
        # The sums by context are made of partial sums, and a context's rows are not gathered.
        contexts = stored(seen[order].select(context, "n", cut.alias("cut")).groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left")), "contexts")
        own = asked[order].join(seen[order].select("gram", ((F.col("n") - cut)).alias("more")), "gram", "left")
        if order == 1:
            total = contexts.first()
            total, left = (total["total"], total["left"]) if total else (1, 1.0)
            level = own.select("gram", ((F.coalesce("more", F.lit(0.0)) + F.lit(left / symbols)) / F.lit(float(total))).alias("p"))
        else:
            parts = own.withColumn("suffix", F.expr(_suffix(order - 1))).withColumn("context", context)
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("more", F.lit(0.0)) + F.col("left") * F.col("below")) / F.col("total"))
            level = parts.join(contexts, "context", "left").join(below, "suffix").select("gram", p.alias("p"))
        lower = stored(level, "level")
    return lower.select("gram", F.log("p").cast("float").alias("logp"))


def score(text: str | None, grams: np.ndarray, logp: np.ndarray) -> tuple[float | None, int]:
    """Log perplexity per symbol of a text, and the number of its symbols and its end."""
    if _blank(text):
        return None, 0
    total, n = 0.0, 0
    for code in _codes(text):
        total -= float(logp[np.searchsorted(grams, code)].sum(dtype=np.float64))
        n += len(code)
    return round(total / n, 6), n


def scored(rows: DataFrame, model: BlockFiles, flags: BlockFiles) -> DataFrame:
    """``row``, ``key``, ``lang``, ``nll`` (log perplexity), ``chars`` and ``fold`` (-1: not trusted)."""
    schema = pa.schema([("row", pa.int64()), ("key", to_arrow_type(rows.schema["key"].dataType)), ("lang", pa.string()), ("nll", pa.float64()), ("chars", pa.int64()), ("fold", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trusted = _ByBlock(model), _ByBlock(flags)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                places = part.column(0).to_pylist()
                nll, chars = zip(*(score(t.as_py(), *known.of(r >> BLOCK_BITS)) for r, t in zip(places, part.column(3), strict=True)), strict=True)
                folds = [_folds(trusted, r) for r in places]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nll, pa.float64()), pa.array(chars, pa.int64()), pa.array(folds, pa.int64())], schema=schema)

    return rows.select("row", "key", "lang", "text").mapInArrow(run, from_arrow_schema(schema))


def thresholds(scores: DataFrame) -> DataFrame:
    """(lang, limit) from the held-out trusted documents; the row of all languages has ``every`` set.

    Quantiles are exact on scores in steps of 0.001, counted by step, so no group is gathered."""
    held = scores.where("fold = 0 and nll is not null").select("lang", F.floor((F.col("nll") - ROOM / F.sqrt("chars")) * 1000).alias("step"))
    both = held.withColumn("every", F.lit(False)).unionByName(held.select(F.lit(None).cast("string").alias("lang"), "step", F.lit(True).alias("every")))
    counted = both.where("every or lang is not null").groupBy("every", "lang", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("every", "lang")
    ranked = counted.withColumn("_all", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(w.orderBy("step")))
    found = ranked.where(F.col("_upto") >= QUANTILE * F.col("_all")).groupBy("every", "lang").agg((F.min("step") / 1000 + 0.001).alias("limit"), F.max("_all").alias("_all"))
    return stored(found.where((F.col("_all") >= LEAST_CALIBRATION) | F.col("every")).select("every", "lang", (F.col("limit") + SLACK).alias("limit")), "limits")


def model_of(rows: DataFrame, flags: BlockFiles) -> BlockFiles:
    """The n-grams of each block of ``rows`` (``row``, ``text``) with their log probabilities."""
    counted = stored(count(rows, flags), "counts")
    grams = stored(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    # Two tasks may hold parts of a block; an n-gram that both have is then in its files twice, alike.
    return BlockFiles(counted.select("gram", "block").join(probabilities(grams).hint("merge"), "gram"), "model")


def judged(rows: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str, row: str) -> DataFrame:
    """``row``, ``key``, ``lang``, ``nll``, ``chars``, ``limit`` and ``kept`` of each of the numbered ``rows``."""
    narrow = rows.select(by_name(row).alias("row"), by_name(key).alias("key"), by_name(lang).cast("string").alias("lang"), by_name(text).cast("string").alias("text"))
    flags = BlockFiles(_flags(narrow, labels.select(by_name(key).alias("key"), by_name(label).alias("label")), "key", "label"), "flags")
    scores = stored(scored(narrow, model_of(narrow, flags), flags), "scores")
    limits = thresholds(scores)
    overall = limits.where("every").select("limit").collect()  # one row at most
    overall = overall[0]["limit"] if overall else float("inf")
    limit = F.coalesce("limit", F.lit(overall)) + ROOM / F.sqrt(F.greatest(F.col("chars"), F.lit(1)))
    joined = scores.join(limits.where("not every").select("lang", "limit"), "lang", "left").withColumn("limit", limit)
    return joined.withColumn("kept", F.coalesce(F.col("nll") <= F.col("limit"), F.lit(False)))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """Key, ``lang``, ``perplexity`` per symbol, ``threshold`` and ``kept`` of each row."""
    row = free_name(df, "row")
    out = judged(numbered(df, row), labels, key, text, lang, label, row)
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), "kept")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    row = free_name(df, "row")
    rows = numbered(df, row)
    good = judged(rows, labels, key, text, lang, label, row).where("kept")
    kept = BlockFiles(good.select(F.expr(f"shiftright(row, {BLOCK_BITS})").alias("block"), "row"), "kept")
    schema, at = to_arrow_schema(rows.schema), rows.columns.index(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _ByBlock(kept)
        for batch in batches:
            places = batch.column(at).to_numpy()
            good = np.zeros(len(places), bool)
            for block in np.unique(places >> BLOCK_BITS):
                good |= np.isin(places, files.of(int(block))[0])
            yield pa.RecordBatch.from_arrays(batch.columns, schema=schema).filter(pa.array(good))

    return rows.mapInArrow(run, from_arrow_schema(schema)).select(*map(by_name, df.columns))
