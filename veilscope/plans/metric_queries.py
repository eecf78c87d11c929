"""Queries over scored predictions and membership scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import normalize
from ..operators import membership, metrics
from . import proxies
from .proxies import PREDICTIONS, SCORES
from .registry import query, table

_N = proxies.norm_sql


def _overlap_sql(p: str, g: str) -> str:
    """How many words two lists share."""
    return f"list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w)))))"


def _f1_sql(p: str, g: str) -> str:
    """Token F1 of two lists of words."""
    return f"CASE WHEN len({p}) + len({g}) = 0 THEN 1.0::DOUBLE WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {_overlap_sql(p, g)} / (len({p}) + len({g})) END"


def _words(x: str) -> str:
    return f"list_filter(string_split({_N(x)}, ' '), lambda w: w <> '')"


_SCORED = f"""{PREDICTIONS}, pw AS (SELECT *, {_words('prediction')} AS p, {_words('gold')} AS g, {_words('answers[2]')} AS g2 FROM pred),
 own_score AS (SELECT * EXCLUDE (p, g, g2), CASE WHEN {_N('prediction')} = {_N('gold')} THEN 1.0::DOUBLE ELSE 0.0 END AS exact_match, {_f1_sql('p', 'g')} AS token_f1,
   CASE WHEN {_N('prediction')} = {_N('answers[2]')} OR {_N('prediction')} = {_N('gold')} THEN 1.0::DOUBLE ELSE 0.0 END AS best_em, greatest({_f1_sql('p', 'g')}, {_f1_sql('p', 'g2')}) AS best_f1 FROM pw)"""
_BASE = f"""cnt AS (SELECT scenario, coarse_type, {_N('gold')} AS a, count(*) AS n FROM pred GROUP BY ALL), tot AS (SELECT scenario, coarse_type, sum(n) AS size FROM cnt GROUP BY ALL),
 wd AS (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS w FROM cnt),
 pl AS (SELECT x.scenario, x.coarse_type, x.a, len(x.w) + len(y.w) AS l, sum(2 * y.n * coalesce({_overlap_sql('x.w', 'y.w')}, 0)) AS s FROM wd x JOIN wd y ON x.scenario = y.scenario AND x.coarse_type = y.coarse_type AND x.a <> y.a GROUP BY ALL),
 pr AS (SELECT scenario, coarse_type, a, sum(CAST(round(s::DOUBLE / l * 1000000000) AS HUGEINT))::DOUBLE / 1000000000 AS s FROM pl GROUP BY ALL),
 base AS (SELECT cnt.scenario, cnt.coarse_type, cnt.a, CASE WHEN size > 1 THEN (n - 1)::DOUBLE / (size - 1) ELSE 1.0 END AS random_em, CASE WHEN size > 1 THEN (n - 1 + coalesce(s, 0))::DOUBLE / (size - 1) ELSE 1.0 END AS random_f1
   FROM cnt JOIN tot USING (scenario, coarse_type) LEFT JOIN pr ON pr.scenario = cnt.scenario AND pr.coarse_type = cnt.coarse_type AND pr.a = cnt.a)"""
_FULL = f"{_SCORED}, {_BASE}, full_ AS (SELECT o.*, b.random_em, b.random_f1, exact_match - b.random_em AS corrected_em, token_f1 - b.random_f1 AS corrected_f1 FROM own_score o JOIN base b ON b.scenario = o.scenario AND b.coarse_type = o.coarse_type AND b.a = {_N('o.gold')})"
_MEANS = ", ".join(f"{metrics.exact_mean_sql(c)} AS {c}" for c in metrics.SCORES)


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Sums of floats depend on their order beyond these digits."""
    return df.withColumns({c: F.round(c, places) for c in names})


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    p, g = F.col("prediction"), F.col("gold")
    return proxies.predictions(spark, sf).withColumns({"exact_match": scoring.exact_match(p, g), "token_f1": scoring.token_f1(p, g)})


def _full(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.random_baseline(_scored(spark, sf), ["scenario", "coarse_type"])
    return rows.withColumns({"corrected_em": F.col("exact_match") - F.col("random_em"), "corrected_f1": F.col("token_f1") - F.col("random_f1")})


@query(f"WITH {_SCORED} SELECT example_id, scenario, exact_match FROM own_score")
def score_em(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("example_id", "scenario", "exact_match")


@query(f"WITH {_SCORED} SELECT example_id, scenario, round(token_f1, 9) AS token_f1 FROM own_score")
def score_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_scored(spark, sf).select("example_id", "scenario", "token_f1"), "token_f1", places=9)


@query(f"WITH {_SCORED} SELECT example_id, scenario, best_em, round(best_f1, 9) AS best_f1 FROM own_score")
def score_best(spark: SparkSession, sf: str) -> DataFrame:
    p, a = F.col("prediction"), F.col("answers")
    rows = proxies.predictions(spark, sf).select("example_id", "scenario", scoring.best(scoring.exact_match, p, a).alias("best_em"), scoring.best(scoring.token_f1, p, a).alias("best_f1"))
    return _rounded(rows, "best_f1", places=9)


@query(f"WITH {_FULL} SELECT example_id, scenario, round(random_em, 6) AS random_em, round(random_f1, 6) AS random_f1 FROM full_")
def random_baseline_expected(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_full(spark, sf).select("example_id", "scenario", "random_em", "random_f1"), "random_em", "random_f1")


@query(f"WITH {_FULL} SELECT example_id, scenario, round(corrected_em, 6) AS corrected_em, round(corrected_f1, 6) AS corrected_f1 FROM full_")
def score_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_full(spark, sf).select("example_id", "scenario", "corrected_em", "corrected_f1"), "corrected_em", "corrected_f1")


@query(f"WITH {_FULL} SELECT example_id, scenario, {_N('prediction')} AS normalized_prediction, {_N('gold')} AS normalized_answer, {', '.join(f'round({c}, 6) AS {c}' for c in metrics.SCORES)} FROM full_")
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _full(spark, sf).select("example_id", "scenario", normalize(F.col("prediction")).alias("normalized_prediction"), normalize(F.col("gold")).alias("normalized_answer"), *metrics.SCORES)
    return _rounded(rows, *metrics.SCORES)


@query(f"WITH {PREDICTIONS} SELECT scenario, avg(1.0::DOUBLE) AS exact_match, count(*) AS n FROM pred GROUP BY scenario")
def predict_oracle(spark: SparkSession, sf: str) -> DataFrame:
    """The control that answers with the gold answer."""
    rows = proxies.predictions(spark, sf).withColumn("prediction", F.col("gold"))
    return rows.groupBy("scenario").agg(F.avg(scoring.exact_match(F.col("prediction"), F.col("gold"))).alias("exact_match"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_type, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS size FROM part),
w AS (SELECT *, CAST(concat('0x', substr(md5('7:' || CAST(p_partkey AS VARCHAR)), 1, 12)) AS BIGINT) AS h FROM p),
o AS (SELECT w.p_partkey, q.p_name, row_number() OVER (PARTITION BY w.p_partkey ORDER BY q.place) - 1 AS k, w.h % count(*) OVER (PARTITION BY w.p_partkey) AS pick FROM w JOIN p q ON q.p_type = w.p_type AND (q.p_partkey <> w.p_partkey OR w.size = 1))
SELECT p_partkey, p_name AS prediction FROM o WHERE k = pick""")
def predict_random(spark: SparkSession, sf: str) -> DataFrame:
    """The control that answers with a seeded pick from the other rows of its type, or its own if there is no other."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    placed = p.withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")) - 1)
    sizes = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("size"))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))), 1, 12), 16, 10).cast("long") % F.greatest(F.col("size") - 1, F.lit(1))
    wanted = placed.join(sizes, "p_type").select("p_partkey", "p_type", (pick + ((pick >= F.col("place")) & (F.col("size") > 1)).cast("int")).alias("place"))
    return wanted.join(placed.select("p_type", "place", F.col("p_name").alias("prediction")), ["p_type", "place"]).select("p_partkey", "prediction")


@query("SELECT p_type, count(*) AS n, count(DISTINCT p_name) AS answers FROM part GROUP BY p_type")
def answer_pool(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("answers"))


@query(f"WITH {_FULL} SELECT scenario, count(*) AS n_examples, {_MEANS} FROM full_ GROUP BY scenario")
def metrics_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.means(_full(spark, sf), "scenario")


@query(f"WITH {_FULL} SELECT scenario, coarse_type, count(*) AS n_examples, {_MEANS} FROM full_ GROUP BY ALL")
def metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.means(_full(spark, sf), "scenario", "coarse_type")


_TOTALS = f"SELECT split, scenario, CASE WHEN grouping(coarse_type) = 1 THEN 'ALL' ELSE coarse_type END AS coarse_type, count(*) AS n_examples, {_MEANS} FROM full_ GROUP BY GROUPING SETS ((split, scenario, coarse_type), (split, scenario))"


@query(f"WITH {_FULL} {_TOTALS}")
def extraction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.means_with_totals(_full(spark, sf), ["split", "scenario"], "coarse_type")


@query(f"WITH {_FULL}, t AS ({_TOTALS}) SELECT scenario, corrected_em FROM t WHERE split = 'seen' AND coarse_type = 'ALL' AND scenario IN ('original', 'img_black')")
def extraction_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = extraction_metrics(spark, sf).where("split = 'seen' AND coarse_type = 'ALL' AND scenario IN ('original', 'img_black')")
    return rows.select("scenario", "corrected_em")


@query(f"WITH {_SCORED} SELECT example_id, scenario, prediction FROM own_score WHERE split = 'seen' AND scenario <> 'original' AND exact_match >= 1 ORDER BY example_id, scenario LIMIT 20")
def extraction_success_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).where("split = 'seen' AND scenario <> 'original' AND exact_match >= 1")
    return rows.select("example_id", "scenario", "prediction").orderBy("example_id", "scenario").limit(20)


@query(f"WITH {_SCORED}, r AS (SELECT split, exact_match, row_number() OVER (PARTITION BY split ORDER BY example_id) AS rn FROM own_score WHERE scenario = 'original') SELECT split, avg(exact_match) AS exact_match, count(*) AS n FROM r WHERE rn <= 100 GROUP BY split")
def sanity_em(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).where("scenario = 'original'").withColumn("_rank", F.row_number().over(Window.partitionBy("split").orderBy("example_id")))
    return rows.where("_rank <= 100").groupBy("split").agg(F.avg("exact_match").alias("exact_match"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORES} SELECT event_type AS field_type, {metrics.exact_mean_sql('(CASE WHEN s.confidence IS NOT NULL AND NOT isnan(s.confidence) AND NOT isinf(s.confidence) THEN s.confidence END)')} AS train_loss FROM events JOIN sc s ON s.example_id = event_id GROUP BY 1")
def epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss of each epoch over finite batches; event types stand for epochs."""
    return proxies.scores(spark, sf).groupBy("field_type").agg(metrics.exact_mean(membership.finite(F.col("confidence"))).alias("train_loss"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:coalesce(nullif(list_position([(vec_id + 1) % 7, (vec_id + 2) % 7, (vec_id + 3) % 7, (vec_id + 4) % 7], 2), 0), 4)], lambda x: CASE WHEN vec_id % 11 = 0 THEN '-Infinity'::DOUBLE ELSE -abs(x::DOUBLE) END) AS logs FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN -100.0::DOUBLE WHEN vec_id % 13 = 0 THEN 0.0 ELSE round(list_avg(logs), 6) END AS confidence FROM v""")
def seq_confidence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    tokens = F.array(*((F.col("vec_id") + i) % 7 for i in (1, 2, 3, 4)))
    every = F.transform(F.slice("embedding", 1, 4), lambda x: F.when(F.col("vec_id") % 11 == 0, float("-inf")).otherwise(-F.abs(x.cast("double"))))
    logs = F.when((F.col("vec_id") % 13 == 0) & (F.col("vec_id") % 11 != 0), F.array().cast("array<double>")).otherwise(every)
    return _rounded(e.select("vec_id", scoring.sequence_confidence(logs, tokens, 2).alias("confidence")), "confidence")


@query(f"WITH {SCORES} SELECT * FROM fin")
def mia_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    rows = proxies.scores(spark, sf)
    return rows.withColumns({c: membership.finite(F.col(c)) for c in ("confidence", "loss")}).where("confidence IS NOT NULL AND loss IS NOT NULL")


def _auc_sql(score: str, keys: str) -> str:
    return f"""(WITH r AS (SELECT {keys}, split, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS r FROM fin)
 SELECT {keys}, (sum(r) FILTER (split = 'seen') - count(*) FILTER (split = 'seen') * (count(*) FILTER (split = 'seen') + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (split = 'seen') * count(*) FILTER (split <> 'seen'), 0) AS auc FROM r GROUP BY {keys})"""


def _fin(spark: SparkSession, sf: str) -> DataFrame:
    return mia_sanitize(spark, sf)


@query(f"WITH {SCORES} SELECT model, round(c.auc, 6) AS auc_confidence, round(l.auc, 6) AS auc_loss FROM {_auc_sql('confidence', 'model')} c JOIN {_auc_sql('-loss', 'model')} l USING (model)")
def mia_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows, seen = _fin(spark, sf), F.col("split") == "seen"
    conf = membership.auc(rows, "confidence", seen, "model").withColumnRenamed("auc", "auc_confidence")
    loss = membership.auc(rows.withColumn("loss", -F.col("loss")), "loss", seen, "model").withColumnRenamed("auc", "auc_loss")
    return _rounded(conf.join(loss, "model"), "auc_confidence", "auc_loss")


@query(f"WITH {SCORES} SELECT model, field_type, round(auc, 6) AS auc FROM {_auc_sql('-loss', 'model, field_type')} WHERE auc IS NOT NULL")
def mia_auc_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fin(spark, sf).withColumn("loss", -F.col("loss"))
    return _rounded(membership.auc(rows, "loss", F.col("split") == "seen", "model", "field_type").where("auc IS NOT NULL"), "auc")


_WELCH = """w AS (SELECT model, avg(confidence) FILTER (split = 'seen') AS m1, avg(confidence) FILTER (split <> 'seen') AS m2, var_samp(confidence) FILTER (split = 'seen') AS v1, var_samp(confidence) FILTER (split <> 'seen') AS v2,
 count(*) FILTER (split = 'seen') AS n1, count(*) FILTER (split <> 'seen') AS n2 FROM fin GROUP BY model)"""


@query(f"WITH {SCORES}, {_WELCH} SELECT model, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t_stat, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS df FROM w")
def mia_welch(spark: SparkSession, sf: str) -> DataFrame:
    out = membership.welch(_fin(spark, sf), "confidence", F.col("split") == "seen", "model")
    return _rounded(_rounded(out, "t_stat", places=5), "df", places=3)


@query()
def mia_welch_p(spark: SparkSession, sf: str) -> DataFrame:
    """With the p value, which SQL lacks; the tests compare it with tabulated ones."""
    return membership.with_p(membership.welch(_fin(spark, sf), "confidence", F.col("split") == "seen", "model"))


_STATS = ["mean_seen_conf", "std_seen_conf", "mean_unseen_conf", "std_unseen_conf", "mean_seen_loss", "mean_unseen_loss", "auc_confidence", "auc_loss"]


@query(f"""WITH {SCORES}, s AS (SELECT model, {metrics.exact_mean_sql("(CASE WHEN split = 'seen' THEN confidence END)", 5)} AS mean_seen_conf, stddev_samp(confidence) FILTER (split = 'seen') AS std_seen_conf, {metrics.exact_mean_sql("(CASE WHEN split <> 'seen' THEN confidence END)", 5)} AS mean_unseen_conf, stddev_samp(confidence) FILTER (split <> 'seen') AS std_unseen_conf,
 {metrics.exact_mean_sql("(CASE WHEN split = 'seen' THEN loss END)", 5)} AS mean_seen_loss, {metrics.exact_mean_sql("(CASE WHEN split <> 'seen' THEN loss END)", 5)} AS mean_unseen_loss, count(*) FILTER (split = 'seen') AS n_seen, count(*) FILTER (split <> 'seen') AS n_unseen FROM fin GROUP BY model),
 a AS (SELECT s.*, c.auc AS auc_confidence, l.auc AS auc_loss FROM s JOIN {_auc_sql('confidence', 'model')} c USING (model) JOIN {_auc_sql('-loss', 'model')} l USING (model))
SELECT model, n_seen, n_unseen, {', '.join(f'round({c}, 5) AS {c}' for c in _STATS)} FROM a""")
def mia_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(membership.summary(proxies.scores(spark, sf), "model"), *_STATS, places=5)


@query(f"WITH {SCORES} SELECT model, split, count(*) AS n, min(confidence) AS lo, max(confidence) AS hi, {metrics.exact_mean_sql('confidence', 5)} AS mean, round(coalesce(stddev_samp(confidence), 0), 5) AS std FROM fin GROUP BY ALL")
def mia_hist_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = "confidence"
    out = _fin(spark, sf).groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), metrics.exact_mean(c, 5).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"))
    return _rounded(out, "mean", "std", places=5)


@query(f"""WITH {SCORES}, b AS (SELECT model, split, min(confidence) AS lo, max(confidence) AS hi FROM fin GROUP BY ALL)
SELECT model, split, CAST(CASE WHEN hi > lo THEN least(floor((confidence - lo) / ((hi - lo) / 30)), 29) ELSE 0 END AS INT) AS bin, count(*) AS n FROM fin JOIN b USING (model, split) GROUP BY ALL""")
def mia_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return membership.histogram(_fin(spark, sf), "confidence", "model", "split")


@query(f"WITH {SCORES}, u AS (SELECT model, avg(confidence) AS m FROM fin WHERE split = 'unseen' GROUP BY model) SELECT model, example_id, round(confidence - m, 5) AS gap FROM fin JOIN u USING (model) WHERE split = 'seen' ORDER BY gap DESC, example_id LIMIT 5")
def confidence_gap_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fin(spark, sf)
    unseen = rows.where("split = 'unseen'").groupBy("model").agg(F.avg("confidence").alias("m"))
    gaps = rows.where("split = 'seen'").join(unseen, "model").select("model", "example_id", F.round(F.col("confidence") - F.col("m"), 5).alias("gap"))
    return gaps.orderBy(F.desc("gap"), "example_id").limit(5)


@query("SELECT p_type, p_partkey, p_name AS answer, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS pool_size FROM part")
def answer_pool_records(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.answer_pool(table(spark, sf, "part"), "p_type", "p_partkey", "p_name")


@query(f"""WITH p AS (SELECT p_type, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS size FROM part),
d AS (SELECT p.*, CAST(concat('0x', substr(md5('42:' || CAST(p_partkey AS VARCHAR) || ':' || CAST(draw AS VARCHAR)), 1, 12)) AS BIGINT) % greatest(size - 1, 1) AS pick FROM p, (SELECT unnest(range(20)) AS draw)),
m AS (SELECT d.p_partkey, d.p_name AS gold, q.p_name AS other FROM d JOIN p q ON q.p_type = d.p_type AND q.place = d.pick + CASE WHEN d.pick >= d.place AND d.size > 1 THEN 1 ELSE 0 END),
w AS (SELECT *, {_words('gold')} AS g, {_words('other')} AS o FROM m)
SELECT p_partkey, {metrics.exact_mean_sql(f"(CASE WHEN {_N('gold')} = {_N('other')} THEN 1.0::DOUBLE ELSE 0.0 END)")} AS random_em, {metrics.exact_mean_sql('(' + _f1_sql('o', 'g') + ')')} AS random_f1 FROM w GROUP BY p_partkey""")
def random_baseline_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sampled_baseline(table(spark, sf, "part"), "p_type", "p_partkey", "p_name").select("p_partkey", "random_em", "random_f1")


@query(f"WITH {_SCORED} SELECT example_id, scenario, CASE WHEN lower(prediction) = lower(gold) THEN 1.0::DOUBLE ELSE 0.0 END AS plain_em FROM own_score")
def score_plain(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.predictions(spark, sf).select("example_id", "scenario", scoring.plain_match(F.col("prediction"), F.col("gold")).alias("plain_em"))
