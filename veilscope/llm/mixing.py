"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Sizes are words. Targets share ``share`` of all words out by weight; a source takes ``most`` times its size at most,
and what lies above is shared anew among the others. The mix is then a number of equal blocks: each block goes to the
source with the highest quotient ``target / (2k + 1)``, k being the blocks it has. A source's documents are dealt out
to shards by a seeded hash, so that no shard grows with a hot source, and its blocks are apportioned to its shards in
the same way, by shard size; a shard takes all its blocks twice at most, and what it can't take goes to others. Within a shard the documents lie end to end in seeded order; the quota takes whole passes
and then a run of blocks from a seeded first block on, around the end. So all but two documents of a shard are taken
whole or left, and the result depends on the rows alone.

Only Catalyst expressions, joins and windows are used. Windows run over sources (one row each), over the shards of a
source and over the documents of a shard, all of them aggregates or bounded by ``SHARD_WORDS``.

Cases: a null or empty text has no words and takes none; a null source is a source of its own, the last one; sources
whose texts are all empty have target 0; repeated rows are laid out one by one, rows of one key and size in the order of
a hash of their texts; an empty table gives an empty result; further columns of any name come along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_CLASS, by_name, free_name, numbered, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 64
SHARD_WORDS = 65_536
#: A source has so many shards at most; with more words than these hold, shards are larger.
MAX_SHARDS = 1_000_000
#: Each source gets so many blocks on average at least; small inputs have smaller blocks.
LEAST_BLOCKS = 200


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _seeded(seed: int, *parts: Column) -> Column:
    """60 bits from an MD5 digest, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], order: list[str], votes: str, seats: str, most: Column | None = None) -> DataFrame:
    """Sainte-Laguë: ``quota`` of each row, the highest quotients first, ties by ``order``; quotas sum to ``seats``.

    ``most``: a row has no quotients beyond so many seats, so what it can't take goes to the next highest of others; it
    must lie less than two seats below the row's share.

    With n rows and N seats the divisor that is right differs from votes / N by a factor within n / 2N of one, so all
    but a few seats of a row are certain and only the candidates near its share are ranked, about four for each row."""
    w = Window.partitionBy(*group)
    share = F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    spread = F.when(F.col(seats) > 0, F.col("_share") * F.col("_n") / (2 * F.col(seats))).otherwise(F.lit(0.0)) + 1
    near = (
        df.withColumn("_all", F.sum(votes).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_share", share)
        .withColumn("_most", F.lit(2**62) if most is None else most)
        .withColumn("_base", F.least(F.greatest(F.lit(0), F.floor(F.col("_share") - spread)), F.col("_most")).cast("long")).withColumn("_top", F.least(F.ceil(F.col("_share") + spread) + 2, F.col("_most") - 1).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_base").over(w))
    )
    seat = F.when(F.col("_top") >= F.col("_base"), F.sequence("_base", "_top")).otherwise(F.array(F.lit(None).cast("long")))
    ranked = near.withColumn("_k", F.explode(seat)).withColumn(
        "_rank", F.row_number().over(w.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, "_k"))
    )
    won = ranked.groupBy(*group, *order).agg(F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col("_all") > 0) & F.col("_k").isNotNull(), 1).otherwise(0)).alias("_won"))
    return near.join(won, [*group, *order]).withColumn("quota", F.col("_base") + F.col("_won")).drop("_all", "_n", "_share", "_most", "_base", "_top", "_left", "_won")


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: its size, target, block length and number of shards, and the number of all blocks."""
    sources = sizes.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    weighed = (
        sources.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("asked", F.lit(SHARE) * F.sum("source_size").over(everything)).withColumn("most", MOST * F.col("source_size"))
    )
    # Sources reach their limits in the order of limit by weight; the first that doesn't fixes the level of the rest.
    rising = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("asked") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("_level", level).withColumn("_place", F.row_number().over(rising))
    first = F.min(F.when(F.col("_level") <= F.col("most") / F.col("weight"), F.struct("_place", "_level"))).over(everything)
    found = levels.withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), first["_level"] * F.col("weight")), F.col("most").cast("double"))).drop("_level", "_place")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("asked") / (LEAST_BLOCKS * F.count(F.lit(1)).over(everything))))).cast("long")
    shard_words = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.sum("source_size").over(everything) / MAX_SHARDS))
    return found.withColumn("block", block).withColumn("blocks", F.round(F.col("asked") / F.col("block")).cast("long")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))


def plan_mix(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Rows with ``source_key``, ``source``, ``size`` and ``hash`` -> also their target, place and taken words.

    ``passes`` whole passes, and the words from ``cut_1`` to ``cut_2`` and from ``cut_3`` to ``cut_4`` of the row once
    more."""
    aims = apportion(targets(rows.select("source_key", "source", "size")).withColumn("_one", F.lit(1)), ["_one"], ["number"], "target", "blocks")
    aims = stored(aims.select("source_key", "number", "source_size", "target", "block", "shards", "quota"), "targets")
    dealt = rows.join(aims.select("source_key", "number", "shards"), "source_key").withColumn("shard", F.expr("pmod(hash, shards)"))
    shard_sizes = dealt.groupBy("source_key", "number", "shard").agg(F.sum("size").alias("shard_size"))
    whole = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    sized_shards = shard_sizes.join(aims.select("source_key", F.col("quota").alias("source_quota"), "block", "source_size", "target"), "source_key")
    quotas = (
        apportion(sized_shards, ["number"], ["shard"], "shard_size", "source_quota", MOST * whole).withColumn("_whole", whole)
        .withColumn("passes", F.when(F.col("_whole") > 0, F.expr("quota div _whole")).otherwise(F.lit(0)))
        .withColumn("_run", F.col("quota") - F.col("passes") * F.col("_whole"))
        .withColumn("_first", F.when(F.col("_whole") > 0, F.pmod(_seeded(seed, F.lit("run"), "number", "shard"), F.col("_whole"))).otherwise(F.lit(0)))
        .select("number", "shard", "source_size", "target", "passes",
                (F.col("_first") * F.col("block")).alias("_from"), (F.least(F.col("_first") + F.col("_run"), F.col("_whole")) * F.col("block")).alias("_to"),
                (F.greatest(F.lit(0), F.col("_first") + F.col("_run") - F.col("_whole")) * F.col("block")).alias("_wrapped"))
    )
    lay = Window.partitionBy("number", "shard").orderBy("hash", "key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("_at", F.coalesce(F.sum("size").over(lay), F.lit(0))).join(quotas, ["number", "shard"])
    cut = lambda c: F.least(F.greatest(c - F.col("_at"), F.lit(0)), F.col("size"))
    return (
        laid.withColumn("cut_1", cut(F.col("_from"))).withColumn("cut_2", cut(F.col("_to"))).withColumn("cut_3", F.lit(0).cast("long")).withColumn("cut_4", cut(F.col("_wrapped")))
        .withColumn("taken", F.col("size") * F.col("passes") + F.col("cut_2") - F.col("cut_1") + F.col("cut_4"))
        .drop("_at", "_from", "_to", "_wrapped", "number", "shard", "shards")
    )


def sized(rows: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, row: str = "row") -> DataFrame:
    """What the plan needs of each of the numbered ``rows``."""
    name = by_name(source).cast("string")
    return rows.select(
        F.col(row).alias("row"), by_name(key).alias("key"), name.alias("source"),
        F.when(name.isNull(), "null").otherwise(F.concat(F.lit("="), name)).alias("source_key"), words(by_name(text)).alias("size"),
        _seeded(seed, F.coalesce(by_name(key).cast("string"), F.lit("null"))).alias("hash"), F.xxhash64(by_name(text)).alias("text_hash"),
    )


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """Key, ``size``, ``source_size``, ``target`` and ``taken`` of each row."""
    row = free_name(df, "row")
    rows = stored(sized(numbered(df, row), key, source, text, seed, row), "sizes")
    return plan_mix(rows, seed).select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", count: str | None = None, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``df`` as often as they are taken, cut where a run of blocks begins or ends.

    A row appears once for each whole pass and once more for each part of it that lies in the run. ``count``: a column
    that holds the text's length."""
    row, size, piece = (free_name(df, x) for x in ("row", "size", "piece"))
    rows = numbered(df, row)
    plan = plan_mix(stored(sized(rows, key, source, text, seed, row), "sizes"), seed).where("taken > 0")
    full = F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
    part = lambda a, b: F.struct(F.col(a).alias("begin"), F.col(b).alias("end"))
    parts = F.filter(F.concat(F.array_repeat(full, F.col("passes").cast("int")), F.array(part("cut_1", "cut_2"), part("cut_3", "cut_4"))), lambda p: p["end"] > p["begin"])
    joined = rows.join(plan.select(F.col("row").alias(row), F.col("size").alias(size), F.explode(parts).alias(piece)).hint("merge"), row)
    begin, end = F.col(piece)["begin"], F.col(piece)["end"]
    spaced = F.regexp_extract_all(by_name(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(spaced, (begin + 1).cast("int"), (end - begin).cast("int")), "")
    whole = (begin == 0) & (end == F.col(size))
    out = joined.withColumn(text, F.when(whole, by_name(text)).otherwise(cut))
    if count:
        out = out.withColumn(count, F.when(whole, by_name(count)).otherwise(F.length(by_name(text)).cast(df.schema[count].dataType)))
    return out.select(*map(by_name, df.columns))


_SEEDED = "CAST(concat('0x', substr(md5({}), 1, 15)) AS BIGINT)"
MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         {_SEEDED.format("concat('7:', coalesce(CAST(doc_id AS VARCHAR), 'null'))")} AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM s
), v AS (
  SELECT *, [3, 1, 2][CAST(number % 3 + 1 AS INT)] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS asked, 2 * source_size AS most, count(*) OVER () AS n FROM w
), l AS (
  SELECT *, row_number() OVER up AS place,
         (asked - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM v WINDOW up AS (ORDER BY most::DOUBLE / weight, number), before AS (ORDER BY most::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS found FROM l WHERE level <= most::DOUBLE / weight ORDER BY place LIMIT 1
), t AS (
  SELECT l.*, coalesce(least(most::DOUBLE, found * weight), most::DOUBLE) AS target,
         CAST(greatest(1, least(64, floor(asked / (200 * n)))) AS BIGINT) AS block,
         CAST(greatest(1, ceil(source_size / greatest(65536, ceil(sum(source_size) OVER () / 1000000)))) AS BIGINT) AS shards
  FROM l LEFT JOIN f ON true
), b AS (
  SELECT *, CAST(round(asked / block) AS BIGINT) AS blocks, sum(target) OVER () AS votes FROM t
), c AS (
  SELECT b.number, k.k, row_number() OVER (ORDER BY target / (2 * k.k + 1) DESC, b.number, k.k) AS r, blocks
  FROM b, LATERAL (SELECT unnest(range(CAST(ceil(target * blocks / votes * (1 + n / (2.0 * blocks))) AS BIGINT) + 3)) AS k) k
  WHERE votes > 0
), q AS (
  SELECT b.*, coalesce(a.quota, 0) AS quota FROM b LEFT JOIN (SELECT number, count(*) AS quota FROM c WHERE r <= blocks GROUP BY number) a USING (number)
), e AS (
  SELECT d.*, q.number, q.source_size, q.target, q.block, q.quota AS source_quota, d.h % q.shards AS shard
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), p AS (
  SELECT number, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(block) AS block, any_value(source_quota) AS seats FROM e GROUP BY number, shard
), p2 AS (
  SELECT *, sum(shard_size) OVER (PARTITION BY number) AS votes, count(*) OVER (PARTITION BY number) AS n FROM p
), pc AS (
  SELECT number, shard, seats, row_number() OVER (PARTITION BY number ORDER BY shard_size::DOUBLE / (2 * k.k + 1) DESC, shard, k.k) AS r
  FROM p2, LATERAL (SELECT unnest(range(CAST(ceil(shard_size::DOUBLE * seats / votes * (1 + n / (1.0 * greatest(seats, 1)))) AS BIGINT) + 5)) AS k) k
  WHERE votes > 0 AND k.k < 2 * ceil(shard_size::DOUBLE / block)
), pq AS (
  SELECT p2.*, CAST(ceil(shard_size::DOUBLE / block) AS BIGINT) AS whole, coalesce(a.quota, 0) AS won
  FROM p2 LEFT JOIN (SELECT number, shard, count(*) AS quota FROM pc WHERE r <= seats GROUP BY number, shard) a USING (number, shard)
), pr AS (
  SELECT *, won AS quota, CASE WHEN whole > 0 THEN {_SEEDED.format("concat('7:run:', number, ':', shard)")} % whole ELSE 0 END AS first FROM pq
), ps AS (
  SELECT *, CASE WHEN whole > 0 THEN quota // whole ELSE 0 END AS passes, CASE WHEN whole > 0 THEN quota % whole ELSE 0 END AS run FROM pr
), y AS (
  SELECT e.*, coalesce(sum(size) OVER (PARTITION BY number, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS laid FROM e
)
SELECT doc_id, size, source_size, target,
       CAST(size * passes + least(greatest(least(first + run, whole) * y.block - laid, 0), size) - least(greatest(first * y.block - laid, 0), size)
            + least(greatest(greatest(0, first + run - whole) * y.block - laid, 0), size) AS BIGINT) AS taken
FROM y JOIN ps USING (number, shard)
"""
