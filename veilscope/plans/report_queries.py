"""Queries for reports, checks, sinks that are read again, streams and pixels."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import checks, report, scenarios
from ..operators.metrics import exact_mean, exact_mean_sql
from ..sources import manifests
from ..streaming import live
from .proxies import SCORES
from .registry import query, table

_EVENTS = "ev AS (SELECT event_type, user_id % 3 AS model, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'image_ocr' END AS mode, value FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("model"), F.when(F.col("event_id") % 2 == 0, "image").otherwise("image_ocr").alias("mode"), "value")


@query("SELECT scenario_id, ocr_strategy, image_strategy FROM (VALUES ('x', 'none', 'none')) t(scenario_id, ocr_strategy, image_strategy) WHERE false UNION ALL " + " UNION ALL ".join(
    f"SELECT 'ocr_{o}__img_{i}__k_{k}', '{o}', '{i.split('_')[0]}'" for k in (0, 20) for o in ("none", "drop", "mask") for i in ("none", "black", "white", "blur_10", "blur_20", "blur_50") if (o, i) != ("none", "none")))
def audit_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.grid(spark).where("ocr_strategy <> 'none' OR image_strategy <> 'none'").select("scenario_id", "ocr_strategy", "image_strategy")


@query(f"WITH {_EVENTS} SELECT model, mode, {exact_mean_sql('value')} AS value FROM ev GROUP BY ALL")
def mode_compare(spark: SparkSession, sf: str) -> DataFrame:
    return report.mode_means(_events(spark, sf), ["model", "mode"], "value")


@query("SELECT 'small' AS model, user_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'large', user_id, NULL FROM events WHERE event_type = 'click'")
def report_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return report.tagged_union({"small": e.where("event_type = 'view'").select("user_id", "value"), "large": e.where("event_type = 'click'").select("user_id")}).select("model", "user_id", "value")


@query(f"WITH {_EVENTS} SELECT event_type, {exact_mean_sql("(CASE WHEN mode = 'image' THEN value END)")} AS image, {exact_mean_sql("(CASE WHEN mode = 'image_ocr' THEN value END)")} AS image_ocr FROM ev GROUP BY event_type")
def report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return report.pivot(_events(spark, sf), "event_type", "mode", ["image", "image_ocr"], "value")


@query("SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def report_melt(spark: SparkSession, sf: str) -> DataFrame:
    return report.melt(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("""WITH m AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_brand || ' | ' || p_type END AS key, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS size, p_retailprice AS price FROM part)
SELECT key, 'size' AS metric, size AS value FROM m WHERE size IS NOT NULL UNION ALL SELECT key, 'price', price FROM m WHERE price IS NOT NULL""")
def report_metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("kind"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    return report.metric_rows(rows, ["p_brand", "kind"], ["size", "price"])


@query(f"WITH {SCORES}, a AS (SELECT model, {exact_mean_sql('confidence', 5)} AS confidence, {exact_mean_sql('loss', 5)} AS loss FROM fin GROUP BY model) SELECT model, 'confidence' AS metric, confidence AS value FROM a UNION ALL SELECT model, 'loss', loss FROM a")
def report_mia_bars(spark: SparkSession, sf: str) -> DataFrame:
    from .metric_queries import mia_sanitize

    means = mia_sanitize(spark, sf).groupBy("model").agg(exact_mean("confidence", 5).alias("confidence"), exact_mean("loss", 5).alias("loss"))
    return report.melt(means, ["model"], ["confidence", "loss"])


@query("SELECT n_name, round(log10(sum(c_acctbal + 2000)), 6) AS log_params FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def report_scaling(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal") + 2000).alias("params"))
    named = sums.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return report.scaling(named, F.col("params")).select("n_name", F.round("log_params", 6).alias("log_params"))


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT a.k AS nation, customers, suppliers FROM a LEFT JOIN b USING (k)")
def report_scatter(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "left")


@query(f"WITH {_EVENTS}, m AS (SELECT model, event_type, {exact_mean_sql('value')} AS value FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value DESC, event_type) AS rn FROM m) SELECT model, event_type, value FROM r WHERE rn = 1")
def report_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return report.best_by(_events(spark, sf), ["model"], "event_type", "value")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS text_full, count(*) FILTER (lang NOT IN ('en', 'de')) AS lang_known, count(*) FILTER (n_chars <> length(text)) AS length_right, count(*) - count(DISTINCT doc_id) AS ids FROM documents)
SELECT 'not_empty' AS "check", n > 0 AS passed, CAST(CASE WHEN n > 0 THEN 0 ELSE 1 END AS BIGINT) AS failures FROM c UNION ALL SELECT 'text_full', text_full = 0, text_full FROM c UNION ALL SELECT 'lang_known', lang_known = 0, lang_known FROM c
UNION ALL SELECT 'length_right', length_right = 0, length_right FROM c""")
def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return checks.run_checks(d, {"text_full": checks.full("text"), "lang_known": F.col("lang").isin("en", "de"), "length_right": F.col("n_chars") == F.length("text")})


@query("SELECT doc_id, md5(text) AS text_md5, ['a', text[1:3]] AS answers FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON lines and read with their schema."""
    rows = table(spark, sf, "documents").select("doc_id", "text", F.array(F.lit("a"), F.substring("text", 1, 3)).alias("answers"))
    back = manifests.read_jsonl(spark, manifests.write_jsonl(rows, manifests.scratch(spark, "manifest")), rows.schema)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "answers")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as CSV with a header and read with their schema."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return manifests.read_csv(spark, manifests.write_csv(rows, manifests.scratch(spark, "csv")), rows.schema)


@query("SELECT p_partkey, sum(x) AS total FROM (SELECT p_partkey, p_size AS x FROM part) GROUP BY p_partkey HAVING false")
def empty_source(spark: SparkSession, sf: str) -> DataFrame:
    """An optional table that does not exist is an empty frame with its schema."""
    return manifests.read_optional(spark, f"{tempfile.gettempdir()}/there-is-no-such-table", "p_partkey long, total decimal(38,0)")


@query(f"SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, {exact_mean_sql('value')} AS value FROM events GROUP BY ALL")
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means of a stream of scored rows, run to its end."""
    return live.hourly_metrics(spark, f"{sf}/events.parquet")


@query("SELECT event_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """A stream in which every row comes twice, without repetitions."""
    return live.first_of_each(spark, f"{sf}/events.parquet")


@query()
def pixel_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic pictures masked in a box; what changed inside and outside of it."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit("black"), F.lit("white"), F.lit("blur"))).alias("strategy"))
    picture = pixels.synthetic(F.col("vec_id"), F.lit(32), F.lit(24))
    box = F.array(*map(F.lit, (4, 6, 20, 18)))
    masked = rows.withColumn("picture", picture).withColumn("masked", pixels.mask(F.col("picture"), F.lit(32), F.lit(24), F.array(box), F.col("strategy"), F.lit(4.0)))
    inside = pixels.differs("picture", "masked", F.lit(32), F.lit(24), box)
    return masked.select("vec_id", "strategy", F.length("masked").cast("long").alias("bytes"), inside.alias("inside"), pixels.differs("picture", "masked", F.lit(32), F.lit(24), F.array(*map(F.lit, (22, 0, 32, 24)))).alias("outside"))


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A manifest of parts with some faults, its lines, and the pictures that exist."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    word = lambda w, i: F.struct(w.alias("text"), F.array((10 * i).cast("double"), F.lit(0.0), (10 * i + 8).cast("double"), F.lit(6.0)).alias("bbox"))
    every = lambda n, value, other: F.when(key % n == 0, value).otherwise(other)
    text = lambda c: F.lit(c)
    words = F.split("p_name", " ")
    records = p.select(
        text("parts").alias("dataset_name"), text("train").alias("split"), key.alias("local_row_id"), key.cast("string").alias("example_id"), every(89, text(" "), text("What is it?")).alias("question"), F.get(words, F.lit(0)).alias("answer"), F.array("p_name").alias("answers"),
        text("ORG_NAME").alias("field_type"), every(53, F.lit(None).cast("string"), text("ORG")).alias("coarse_field_type"), text("names").alias("field_group"), text("low").alias("sensitivity"), F.lit(0).alias("answer_start_idx"), every(61, F.lit(-1), F.lit(0)).alias("answer_end_idx"),
        F.array(*map(F.lit, (0, 0, 8, 6))).alias("answer_bbox"), F.transform(words, word).alias("ocr_tokens"), F.concat(text("/pictures/"), every(50, F.lit(0), key).cast("string")).alias("image_path"), F.array(every(97, F.lit(0), F.col("p_size").cast("int")), F.lit(24)).alias("image_size"),
    )
    lines = p.select(every(71, text(" "), F.to_json(F.struct("p_partkey", "p_name"))).alias("value"))
    images = p.where("p_partkey % 43 <> 0").select(F.concat(text("/pictures/"), key.cast("string")).alias("path"), (key % 37 != 0).alias("readable"))
    return records, lines, images


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_partkey END AS img, p_size FROM part), p AS (SELECT img, count(*) AS n FROM r GROUP BY img), j AS (SELECT p.*, f.p_partkey AS there FROM p LEFT JOIN part f ON f.p_partkey = p.img AND f.p_partkey % 43 <> 0),
c AS (SELECT 'manifest_not_empty' AS "check", CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS failures FROM r UNION ALL SELECT 'manifest_required_fields_non_empty', count(*) FROM r WHERE k % 89 = 0 OR k % 53 = 0 UNION ALL SELECT 'manifest_image_sizes_valid', count(*) FROM r WHERE k % 97 = 0 OR p_size <= 0
 UNION ALL SELECT 'ocr_drop_removes_answer_span', 0 UNION ALL SELECT 'ocr_mask_replaces_with_redacted', count(*) FROM r WHERE k % 61 = 0 UNION ALL SELECT 'original_images_exist', count(*) FROM j WHERE there IS NULL
 UNION ALL SELECT 'manifest_matches_real_original_files', CAST(sum(n - 1) + count(*) FILTER (there IS NULL) AS BIGINT) FROM j UNION ALL SELECT 'original_images_readable', count(*) FROM j WHERE there % 37 = 0 UNION ALL SELECT 'summary_matches_manifest_count', 0
 UNION ALL SELECT 'manifest_no_blank_lines', count(*) FROM r WHERE k % 71 = 0 UNION ALL SELECT 'manifest_expected_columns', 0)
SELECT "check", failures = 0 AS passed, failures FROM c""")
def manifest_checks_full(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of a manifest over one of that shape."""
    records, lines, images = _manifest(spark, sf)
    return checks.manifest_checks(records, lines, images, records.count())


@query("SELECT count(*) AS total_seen, CAST(sum(p_size) AS BIGINT) AS sizes FROM part")
def json_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A summary written as a JSON object and read again."""
    total = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("total_seen"), F.sum("p_size").alias("sizes"))
    return spark.read.schema(total.schema).json(manifests.write_summary(total, manifests.scratch(spark, "summary")))
