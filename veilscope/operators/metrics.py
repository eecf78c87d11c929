"""Aggregates over scored predictions, and the random baseline in expectation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import exact_match, token_f1
from ..functions.text import normalize

SCORES = ("exact_match", "token_f1", "random_em", "random_f1", "corrected_em", "corrected_f1")


def nanos(c: Column) -> Column:
    """A number in billionths, as a whole number: sums of these do not depend on their order."""
    return F.round(c * 1_000_000_000).cast("decimal(20,0)")


def exact_mean(c: Column | str, places: int = 6) -> Column:
    """The mean of a column of numbers above -10**6, rounded half up; whole numbers all the way, so that repeated runs
    and other engines agree even where the mean lies between two roundings."""
    c = F.col(c) if isinstance(c, str) else c
    unit, lift = 10 ** (9 - places), 10**6
    n = F.count(c).cast("decimal(20,0)")
    twice = 2 * (F.sum(nanos(c)) + n * F.lit(lift * 10**9).cast("decimal(20,0)")) + n * unit
    whole = F.call_function("div", twice.cast("decimal(38,0)"), F.nullif((n * (2 * unit)).cast("decimal(38,0)"), F.lit(0)))
    return ((whole - lift * 10**places).cast("double") / 10**places).cast("double")


def exact_mean_sql(c: str, places: int = 6) -> str:
    """The same for other engines."""
    unit, lift = 10 ** (9 - places), 10**6
    return f"CAST((2 * (sum(CAST(round({c} * 1000000000) AS HUGEINT)) + count({c}) * {lift * 10**9}::HUGEINT) + count({c}) * {unit}) // nullif(count({c}) * {2 * unit}, 0) - {lift * 10**places} AS DOUBLE) / {10**places}"


def means(df: DataFrame, *keys: str) -> DataFrame:
    """Number of rows and mean of each score by ``keys``; null keys are groups too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_examples"), *(exact_mean(c).alias(c) for c in SCORES))


def means_with_totals(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Means by keys and kind together with those of all kinds (``ALL``), in one pass by grouping sets; rows with a
    null key take no part."""
    full = df.dropna(subset=[*keys, kind])
    grouped = full.groupingSets([[*map(F.col, keys), F.col(kind)], [F.col(k) for k in keys]], *map(F.col, keys), F.col(kind))
    rows = grouped.agg(F.grouping(kind).alias("_total"), F.count(F.lit(1)).alias("n_examples"), *(exact_mean(c).alias(c) for c in SCORES))
    return rows.withColumn(kind, F.when(F.col("_total") == 1, "ALL").otherwise(F.col(kind))).drop("_total")


def random_baseline(df: DataFrame, pool: list[str], answer: str = "gold") -> DataFrame:
    """``df`` with ``random_em`` and ``random_f1``: the mean scores of the answers of all other rows of its pool (of its
    own answer if there is no other).

    Rows are counted by normalised answer first. F1 is twice the shared words over the lengths of both answers, so the
    sum over all others splits into sums by word: of the answers that have a word, only how often, how long they are and
    how many there are matters. Answers are never paired, however common their words are."""
    rows = df.withColumn("_answer", normalize(F.col(answer)))
    counted = rows.groupBy(*pool, "_answer").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy(*pool).agg(F.sum("_n").alias("_size"))
    bags = counted.withColumn("_bag", F.filter(F.split("_answer", " "), lambda w: w != ""))
    each = F.transform(F.array_distinct("_bag"), lambda w: F.struct(w.alias("_word"), F.size(F.filter("_bag", lambda x: x == w)).alias("_times")))
    words = bags.select(*pool, "_answer", "_n", F.size("_bag").alias("_length"), F.explode(each).alias("_w")).select(*pool, "_answer", "_n", "_length", "_w.*")
    kinds = words.groupBy(*pool, "_word", "_times", "_length").agg(F.sum("_n").alias("_n"))
    other = kinds.select(*pool, "_word", F.col("_times").alias("_other_times"), F.col("_length").alias("_other_length"), F.col("_n").alias("_others"))
    shared = F.sum(2 * F.col("_others") * F.least("_times", "_other_times")).alias("_shared")
    met = kinds.drop("_n").join(other, [*pool, "_word"]).groupBy(*pool, "_word", "_times", "_length", (F.col("_length") + F.col("_other_length")).alias("_both")).agg(shared)
    by_length = words.join(met, [*pool, "_word", "_times", "_length"]).groupBy(*pool, "_answer", "_n", "_length", "_both").agg(F.sum("_shared").alias("_shared"))
    # Equal answers are taken apart, as each row leaves out itself.
    unequal = F.col("_shared") - F.when(F.col("_both") == 2 * F.col("_length"), 2 * F.col("_n") * F.col("_length")).otherwise(0)
    unequal = by_length.groupBy(*pool, "_answer").agg((F.sum(nanos(unequal / F.col("_both"))).cast("double") / 1_000_000_000).alias("_others"))
    others = F.col("_size") - 1
    per_answer = (
        counted.join(sizes, pool).join(unequal, [*pool, "_answer"], "left")
        .withColumn("random_em", F.when(others > 0, (F.col("_n") - 1) / others).otherwise(1.0))
        .withColumn("random_f1", F.when(others > 0, (F.col("_n") - 1 + F.coalesce("_others", F.lit(0.0))) / others).otherwise(1.0))
        .select(*pool, "_answer", "random_em", "random_f1")
    )
    return rows.join(per_answer, [*pool, "_answer"]).drop("_answer")


def sampled_baseline(df: DataFrame, pool: str, key: str, answer: str, draws: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with ``random_em`` and ``random_f1`` over ``draws`` seeded draws, with replacement, from the other rows of
    its pool (from its own row if there is no other).

    A draw is a place in the pool, so rows meet the rows that they have drawn and no others."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("_draw").cast("string"))), 1, 12), 16, 10).cast("long")
    placed = df.select(pool, key, F.col(answer).alias("_gold")).withColumn("_place", F.row_number().over(Window.partitionBy(pool).orderBy(key)) - 1)
    sizes = df.groupBy(pool).agg(F.count(F.lit(1)).alias("_size"))
    drawn = placed.join(sizes, pool).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_pick", hashed % F.greatest(F.col("_size") - 1, F.lit(1)))
    drawn = drawn.withColumn("_pick", F.col("_pick") + ((F.col("_pick") >= F.col("_place")) & (F.col("_size") > 1)).cast("int"))
    met = drawn.select(pool, key, "_gold", "_pick").join(placed.select(pool, F.col("_place").alias("_pick"), F.col("_gold").alias("_other")), [pool, "_pick"])
    means = met.groupBy(key).agg(exact_mean(exact_match(F.col("_other"), F.col("_gold"))).alias("random_em"), exact_mean(token_f1(F.col("_other"), F.col("_gold"))).alias("random_f1"))
    return df.join(means, key)


def answer_pool(df: DataFrame, pool: str, key: str, answer: str) -> DataFrame:
    """The records to draw answers from: each with its pool, its place there and the pool's size."""
    sizes = df.groupBy(pool).agg(F.count(F.lit(1)).alias("pool_size"))
    return df.select(pool, key, F.col(answer).alias("answer"), (F.row_number().over(Window.partitionBy(pool).orderBy(key)) - 1).alias("place")).join(sizes, pool)
