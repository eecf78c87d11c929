"""Which texts contain which passages, and the audit that redacted answers can't be found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import expand, find_spans, let, normalized_tokens, redact, words_of
from ..functions.text import normalize

ANCHOR = 4


def contained(texts: DataFrame, passages: DataFrame, text_key: str, passage_key: str, text: str = "text", passage: str = "text") -> DataFrame:
    """(text, passage) keys where the passage's words occur in a row in the text, both normalised.

    Each passage is anchored by the hash of its first ANCHOR words, a shorter one by that of all its words; texts emit the
    hashes of all their runs of as many words as anchors have, each once, and only matches are checked in full."""
    words = lambda c: F.filter(F.split(normalize(c), " "), lambda w: w != "")
    run = lambda v, i, n: F.xxhash64(*(F.get(v, i + j) for j in range(n)))
    runs = lambda v, n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - n, F.lit(0))), lambda i: run(v, i, n))
    known = passages.select(F.col(passage_key).alias("_p"), words(F.col(passage)).alias("_words")).where(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(ANCHOR))
    lengths = sorted(r["n"] for r in known.select(length.alias("n")).distinct().collect()) or [ANCHOR]  # ANCHOR at most
    anchors = known.select("_p", F.array_join("_words", " ").alias("_passage"), F.coalesce(*(F.when(length == n, run(F.col("_words"), F.lit(0), n)) for n in lengths)).alias("_anchor"))
    long = texts.select(F.col(text_key).alias("_t"), words(F.col(text)).alias("_words"))
    hashes = long.select("_t", F.explode(let(F.col("_words"), lambda v: F.array_distinct(F.concat(*(runs(v, n) for n in lengths))))).alias("_anchor"))
    hits = hashes.join(anchors, "_anchor").select("_t", "_p", "_passage").distinct()
    full = texts.select(F.col(text_key).alias("_t"), F.concat(F.lit(" "), normalize(F.col(text)), F.lit(" ")).alias("_full"))
    found = hits.join(full, "_t").where(F.contains("_full", F.concat(F.lit(" "), F.col("_passage"), F.lit(" "))))
    return found.select(F.col("_t").alias(text_key), F.col("_p").alias(passage_key)).distinct()


def _running(tokens: Column) -> Column:
    """Normalised tokens as one text with blanks around each word."""
    return F.concat(F.lit(" "), F.array_join(F.filter(tokens, lambda t: t != ""), " "), F.lit(" "))


def _redacted_text(tokens: Column, spans: Column, strategy: str) -> Column:
    """What is left of normalised tokens to be searched; the mask is normalised as well."""
    return _running(redact(tokens, spans, strategy, fixed.MASK_TEXT.strip("[]").lower()))


def _needle(answer: Column) -> Column:
    return F.concat(F.lit(" "), normalize(answer), F.lit(" "))


def leak_audit(rows: DataFrame, keys: list[str], strategies: tuple[str, ...] = ("none", "drop", "mask")) -> DataFrame:
    """For each strategy and group: answers checked, those found again after redaction, and whether none was.

    ``rows`` have ``tokens`` and ``answer``. Tokens are normalised once, for the search of the answer's spans and for all
    strategies, and an answer is found again if its words stand in a row in what is left."""
    parts = let(normalized_tokens(F.col("tokens")), lambda t: F.struct(t.alias("tokens"), find_spans(words_of(t), F.col("answer")).alias("spans"), _needle(F.col("answer")).alias("needle")))
    found = lambda v, s: (F.trim(v["needle"]) != "") & F.contains(_redacted_text(v["tokens"], v["spans"], s), v["needle"])
    leaks = let(parts, lambda v: F.array(*(F.struct(F.lit(s).alias("scenario"), found(v, s).alias("leak")) for s in strategies)))
    each = rows.select(*keys, F.explode(leaks).alias("x"))
    return each.groupBy(F.col("x.scenario").alias("scenario"), *keys).agg(F.count(F.lit(1)).alias("checked"), F.count_if("x.leak").alias("leaks"), (F.count_if("x.leak") == 0).alias("passed"))


def _first(df: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """``group`` and ``examples``: its ``n`` first keys; taken in parts first, so that no window holds a large group."""
    part = F.pmod(F.xxhash64(key), F.lit(64))
    some = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(key))).where(F.col("_rank") <= n)
    return some.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).alias("examples"))


def scenario_audit(rows: DataFrame, grid: DataFrame, key: str, image_unchanged: dict[str, Column], most_examples: int = 20) -> DataFrame:
    """A row for each scenario of ``grid`` that redacts anything: records checked and failed, the first failures, and
    whether it, and all of them, passed.

    ``rows`` have ``tokens``, the ``answer`` whose spans are redacted, and ``answers``; a record leaks if any of these
    stands in what is left of its tokens. ``image_unchanged`` says for each picture strategy whether a record's boxes look as before. What a record
    leaks depends on the redaction of words and the context only, so it is computed once for each pair of these."""
    pairs = [(r["ocr_strategy"], r["context_window"]) for r in grid.where("ocr_strategy <> 'none'").select("ocr_strategy", "context_window").distinct().collect()]  # a few
    needles = F.filter(F.transform("answers", _needle), lambda a: F.trim(a) != "")
    parts = let(normalized_tokens(F.col("tokens")), lambda t: F.struct(t.alias("tokens"), find_spans(words_of(t), F.col("answer")).alias("spans"), needles.alias("needles")))

    def leaks(v: Column, strategy: str, k: int) -> Column:
        left = _redacted_text(v["tokens"], expand(v["spans"], k, F.size(v["tokens"])), strategy)
        return let(left, lambda text: F.exists(v["needles"], lambda a: F.contains(text, a)))

    fact = lambda kind, strategy, k, failed: F.struct(F.lit(kind).alias("kind"), F.lit(strategy).alias("strategy"), F.lit(k).cast("int").alias("k"), failed.alias("failed"))
    words = let(parts, lambda v: F.array(*(fact("ocr", s, k, leaks(v, s, k)) for s, k in pairs)))
    pictures = F.array(*(fact("image", s, None, c) for s, c in image_unchanged.items()))
    facts = rows.select(key, F.explode(F.concat(words, pictures)).alias("x")).select(key, "x.*")
    group = ["kind", "strategy", "k"]
    counted = facts.groupBy(*group).agg(F.count(F.lit(1)).alias("checked"), F.count_if("failed").alias("failures"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group]
    known = counted.alias("c").join(_first(facts.where("failed"), group, key, most_examples).alias("e"), same, "left").select(*(f"c.{g}" for g in group), "checked", "failures", "examples")
    side = lambda kind: known.where(F.col("kind") == kind).select(F.col("strategy").alias(f"{kind}_strategy"), F.col("k").alias("context_window"), F.col("checked").alias(f"{kind}_checked"), F.col("failures").alias(f"{kind}_failures"), F.col("examples").alias(f"{kind}_examples"))
    joined = grid.where("ocr_strategy <> 'none' OR image_strategy <> 'none'").join(side("ocr"), ["ocr_strategy", "context_window"], "left").join(side("image").drop("context_window"), "image_strategy", "left")
    none = F.array().cast(facts.select(F.array(key)).dtypes[0][1])
    examples = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("ocr_examples", none), F.coalesce("image_examples", none)))), 1, most_examples)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = joined.select("scenario_id", "ocr_strategy", "image_strategy", "context_window", *map(zero, ("ocr_checked", "ocr_failures", "image_checked", "image_failures")), examples.alias("example_failures"))
    out = out.withColumnsRenamed({"ocr_failures": "ocr_leaks", "image_failures": "image_unchanged"}).withColumn("passed", F.expr("ocr_leaks = 0 AND image_unchanged = 0"))
    return out.withColumn("all_passed", F.min("passed").over(Window.partitionBy()))  # a row for each scenario
