"""Toxicity: bags of subword embeddings, averaged into a linear softmax and trained jointly in numpy.

A word is a run of letters, digits and marks that are no white space, in lower case. Its subwords are the character
n-grams of 3 to 6 characters with the word's borders, and the word itself, hashed into ``BUCKETS`` rows of an embedding
table. A window of ``WINDOW`` words is the mean of its subwords' embeddings; a linear softmax turns it into two
classes. A misspelt word that was never seen shares most of its n-grams, and so most of its vector.

A single insult makes a long text toxic, so a text is scored by its worst window: training first fits whole texts,
then, in every round, the worst window of each text. Windows overlap by half and cover every word.

After training, a subword adds one number to a window's margin, so that scoring is a look-up for each n-gram, sums
over windows and a maximum, all vectorised over whole texts.

The model is fitted on the driver from at most ``MAX_TRAIN_DOCS`` labelled texts with ``MAX_TRAIN_CHARS`` characters
together, the first ones by a hash of their key; held-out rows never take part. Its size is fixed, and it reaches the
workers as one broadcast of ``BUCKETS`` numbers.

Cases: null and empty texts get the score of a window without subwords; texts of any length are scored whole, the
windows of long ones in slices that change none of them; without labels of both classes every score is the share of label 1; equal texts get equal scores; an empty
table gives an empty result; only key and text (and labels in training) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import map_slices

BUCKETS = 1 << 16
DIM = 12
SIZES = (3, 4, 5, 6)
WINDOW = 4
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 6_000, 12_000_000
#: Longer texts take part in training with so many characters from a seeded place on (and in scores as a whole).
MAX_TRAIN_TEXT = 100_000
THRESHOLD = 0.7
_SLICE_CHARS = 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case with one border (0) around each word; first and last position of each word."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)) | (raw == 0))
    # Marks at a word's borders belong to no word.
    letter = inner & ~(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 191) & (raw != 170) & (raw != 181) & (raw != 186)))
    codes = np.zeros(len(raw) + 2, np.uint64)
    codes[1:-1] = np.where(letter, raw, 0)
    edge = np.diff((codes > 0).astype(np.int8))
    return codes, np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords in order of their words, and the number of subwords of each word."""
    codes, first, last = _codes(text)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, word = len(codes), np.zeros(len(codes), np.int64)
    word[first] = 1
    word = np.cumsum(word) - 1  # of a border: the word before it
    filled = codes > 0
    blank = np.cumsum(~filled)
    found, owner = [], []
    hashed = codes.copy()
    with np.errstate(over="ignore"):
        for size in range(2, SIZES[-1] + 1):
            hashed = hashed[:-1] * _BASE + codes[size - 1 :]
            if size < SIZES[0]:
                continue
            at = np.arange(n - size + 1)
            inside = (blank[at + size - 2] - blank[at]) == 0  # no border between the ends
            at = at[inside]
            found.append(((hashed[at] + np.uint64(size)) * _MULT) >> np.uint64(48))
            owner.append(word[at + 1])
        place = np.arange(n) - first[np.clip(word, 0, None)]
        whole = np.add.reduceat(np.where(filled, (codes + np.uint64(1)) * (np.maximum(place, 0).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MULT ^ (codes * _BASE), np.uint64(0)), first)
        found.append((whole * _MULT) >> np.uint64(48))
    owner.append(np.arange(len(first)))
    found, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(first))


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each window."""
    begin = np.arange(0, max(1, len(counts) - WINDOW // 2), WINDOW // 2)
    return begin, np.minimum(begin + WINDOW, len(counts))


def _worst(found: np.ndarray, counts: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> float:
    """The largest mean weight of the subwords of some windows."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([[0.0], np.cumsum(weight[found], dtype=np.float64)])
    return float(((sums[ends[end]] - sums[ends[begin]]) / (ends[end] - ends[begin])).max())


def margins(text: str, weight: np.ndarray, bias: float) -> float:
    """The largest margin of a text's windows.

    A long text is read in slices that begin with the first word whose window the last one did not hold whole."""
    low, at, size, best = text.lower(), 0, _SLICE_CHARS, None
    while at < len(low) or not at:
        part, last = low[at : at + size], at + size >= len(low)
        found, counts = subwords(part)
        if last:
            if len(counts) > (0 if best is None else WINDOW // 2):
                top = _worst(found, counts, *_windows(counts), weight)
                best = top if best is None else max(best, top)
            break
        _, first, ends = _codes(part)
        words = len(first) - bool(len(ends) and ends[-1] == len(part))  # the last one may go on
        begin = np.arange(0, max(0, words - WINDOW + 1), WINDOW // 2)
        if not len(begin):
            if len(first):  # words so long that a slice holds no window
                size *= 2
            else:
                at += size
            continue
        top = _worst(found, counts, begin, begin + WINDOW, weight)
        best = top if best is None else max(best, top)
        at, size = at + int(first[begin[-1] + WINDOW // 2]) - 1, _SLICE_CHARS
    return bias if best is None else best + bias


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(texts: list[str], labels: list[int], rounds: int = 12, rate: float = 0.35, seed: int = 11) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained together; returns each bucket's part of the margin, and the bias.

    Two classes: the margin is the difference of the two logits, ``(w1 - w0) . mean(embeddings) + b1 - b0``."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    squares, squares_w, squares_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    bags = [subwords(t) for t in texts]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for turn in range(rounds):
        part = table @ (w[:, 1] - w[:, 0])
        for chunk in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            picked, owner, gold, weigh = [], [], [], []
            for i in chunk:
                found, counts = bags[i]
                if not len(counts):
                    continue
                ends = np.concatenate([[0], np.cumsum(counts)])
                if turn < 2:
                    lo, hi = 0, len(found)
                else:
                    sums = np.concatenate([[0.0], np.cumsum(part[found], dtype=np.float64)])
                    begin, end = _windows(counts)
                    k = int(((sums[ends[end]] - sums[ends[begin]]) / (ends[end] - ends[begin])).argmax())
                    lo, hi = ends[begin[k]], ends[end[k]]
                picked.append(found[lo:hi])
                owner.append(np.full(hi - lo, len(gold)))
                gold.append(int(y[i]))
                weigh.append(balance[i])
            if not gold:
                continue
            at, own, gold = np.concatenate(picked), np.concatenate(owner), np.array(gold)
            size = np.bincount(own, minlength=len(gold)).astype(np.float32)
            mean = np.stack([np.bincount(own, table[at, d], len(gold)) for d in range(DIM)], 1).astype(np.float32) / size[:, None]
            logits = mean @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(gold)), gold] -= 1
            g = p * np.array(weigh, np.float32)[:, None] / len(gold)
            back = (g @ w.T) / size[:, None] * 64
            grad_w, grad_b = mean.T @ g, g.sum(0)
            squares_w += grad_w**2
            squares_b += grad_b**2
            w -= rate * grad_w / np.sqrt(squares_w)
            b -= rate * grad_b / np.sqrt(squares_b)
            rows, inverse = np.unique(at, return_inverse=True)
            grads = np.stack([np.bincount(inverse, back[own, d], len(rows)) for d in range(DIM)], 1).astype(np.float32)
            squares[rows] += (grads**2).mean(1)
            table[rows] -= rate * grads / np.sqrt(squares[rows])[:, None]
    part = table @ (w[:, 1] - w[:, 0])
    seen = np.zeros(BUCKETS, bool)
    for found, _ in bags:
        seen[found] = True
    part[~seen] = 0.0  # never trained: says nothing
    return _calibrated(bags, y, part.astype(np.float32), float(b[1] - b[0]))


def _calibrated(bags: list, y: np.ndarray, part: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Scale and bias by logistic regression on the worst windows' margins, so that scores are probabilities."""
    x = np.zeros(len(bags))
    for i, (found, counts) in enumerate(bags):
        if len(counts):
            ends, sums = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(part[found], dtype=np.float64)])
            begin, end = _windows(counts)
            x[i] = ((sums[ends[end]] - sums[ends[begin]]) / (ends[end] - ends[begin])).max()
    spread = x.std() or 1.0
    a, c = 1.0, 0.0
    z = (x - x.mean()) / spread
    for _ in range(400):
        e = _sigmoid(a * z + c) - y
        a -= 1.0 * ((e * z).mean() + 1e-4 * a)
        c -= 1.0 * e.mean()
    return (part * (a / spread)).astype(np.float32), float(c - a * x.mean() / spread)


def crc_mod(key: Column, by: int = 3) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most MAX_TRAIN_DOCS rows that are not held out, the first by a hash of their key."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col(key)) != 1)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = marked.withColumn("_hash", F.xxhash64(F.col(key), F.lit(3))).orderBy("_hash", key).limit(MAX_TRAIN_DOCS)
    full = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).where("_text <> ''")
    place = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.greatest(F.lit(1), F.length("_text") - MAX_TRAIN_TEXT + 1)) + 1
    usable = full.withColumn("_text", F.substring("_text", place, F.lit(MAX_TRAIN_TEXT)))
    rows = usable.join(F.broadcast(chosen), key).select("_label", "_text", "_hash").orderBy("_hash", "_text").limit(MAX_TRAIN_DOCS)  # at most MAX_TRAIN_DOCS keys
    texts, classes, held = [], [], 0
    for row in rows.toLocalIterator():
        held += len(row["_text"])
        if held > MAX_TRAIN_CHARS:
            break
        texts.append(row["_text"])
        classes.append(row["_label"])
    return texts, classes


def score(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("key", to_arrow_type(df.schema[key].dataType)), ("score", pa.float64())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        weight, bias = shared.value
        return {"key": rows["key"], "score": [float(np.round(_sigmoid(margins(t or "", weight, bias)), 6)) for t in rows["text"]]}

    return map_slices(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, schema, 256).withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``."""
    model = fit(*training_sample(docs, labels, key, text))
    held_out = F.coalesce(crc_mod(F.col(key)) == 1, F.lit(False))
    return score(docs, model, key, text).select(key, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
