"""Queries over field labels: rules, statistics, gold evaluation, joins, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..operators import classification, joins, sampling, scenarios
from . import proxies
from .proxies import LABELS, QA, TAXONOMY, TYPED
from .registry import query, table

_RULED = f"{TYPED}, r0 AS (SELECT *, lower({proxies.squeeze_sql('question')}) AS q, {proxies.squeeze_sql('answer')} AS a FROM typed), ruled AS (SELECT row_id, template, {rules.label_sql(0)} AS field_type, {rules.label_sql(1)} AS rule_reason, {rules.label_sql(2)} AS rule_confidence FROM r0)"


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.typed(spark, sf).withColumn("_l", rules.label(F.col("question"), F.col("answer"))).select("row_id", "template", "_l.*")


@query(f"WITH {_RULED} SELECT * FROM ruled")
def rule_label(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf)


@query(f"WITH {QA}, r0 AS (SELECT *, lower({proxies.squeeze_sql('question')}) AS q, {proxies.squeeze_sql('answer')} AS a FROM qa) SELECT conv_id, turn, {rules.label_sql(0)} AS field_type, {rules.label_sql(1)} AS rule_reason FROM r0")
def rule_label_talk(spark: SparkSession, sf: str) -> DataFrame:
    label = rules.label(F.col("question"), F.col("answer"))
    return proxies.qa(spark, sf).select("conv_id", "turn", label["field_type"].alias("field_type"), label["rule_reason"].alias("rule_reason"))


@query(f"WITH {_RULED} SELECT field_type, rule_reason, count(*) AS n FROM ruled GROUP BY ALL")
def rule_label_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf).groupBy("field_type", "rule_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RULED} SELECT count(*) AS n, count(*) FILTER (rule_confidence >= 0.93) AS accepted, count(*) FILTER (rule_confidence >= 0.93)::DOUBLE / count(*) AS rate FROM ruled")
def rule_accept_rate(spark: SparkSession, sf: str) -> DataFrame:
    sure = F.col("rule_confidence") >= fixed.ACCEPT_CONFIDENCE
    return _ruled(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("accepted"), F.avg(sure.cast("double")).alias("rate"))


@query(f"""WITH {LABELS}, {TAXONOMY}, l AS (SELECT * FROM lab LEFT JOIN tax USING (field_type)), x AS (
 SELECT 'field_type' AS stat_type, field_type AS stat_value FROM l UNION ALL SELECT 'label_source', label_source FROM l UNION ALL SELECT 'field_group', field_group FROM l UNION ALL SELECT 'sensitivity', sensitivity FROM l)
SELECT stat_type, stat_value, count(*) AS n FROM x GROUP BY ALL""")
def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["field_type", "label_source", "field_group", "sensitivity"]
    rows = scenarios.with_taxonomy(proxies.labels(spark, sf)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("stat_type"), F.col(k).alias("stat_value")) for k in kinds))).alias("x"))
    return rows.groupBy("x.stat_type", "x.stat_value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LABELS} SELECT count(*) AS n_total, count(*) FILTER (label_source = 'rule') AS n_rule, count(*) FILTER (label_source = 'llm') AS n_llm, count(*) FILTER (label_source = 'error') AS n_error,
 count(*) FILTER (field_type = 'OTHER') AS n_other, count(*) FILTER (label_source = 'rule')::DOUBLE / count(*) AS rule_rate FROM lab""")
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    source = lambda s: F.count_if(F.col("label_source") == s).alias(f"n_{s}")
    return proxies.labels(spark, sf).agg(F.count(F.lit(1)).alias("n_total"), source("rule"), source("llm"), source("error"), F.count_if(F.col("field_type") == "OTHER").alias("n_other"), F.avg((F.col("label_source") == "rule").cast("double")).alias("rule_rate"))


@query(f"WITH {LABELS} SELECT row_id, split, question, answer, label_source FROM lab WHERE field_type = 'OTHER'")
def label_other_rows(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.labels(spark, sf).where("field_type = 'OTHER'").select("row_id", "split", "question", "answer", "label_source")


@query(f"WITH {LABELS} SELECT row_id, field_type, rule_confidence FROM lab WHERE label_source = 'llm' AND rule_confidence > 0 ORDER BY rule_confidence DESC, row_id")
def label_audit_cases(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.labels(spark, sf).where("label_source = 'llm' AND rule_confidence > 0").select("row_id", "field_type", "rule_confidence").orderBy(F.desc("rule_confidence"), "row_id")


_FLAG_SQL = """CASE WHEN regexp_matches(q, 'page|figure|table number') AND field_type <> 'DOCUMENT_REFERENCE' THEN ['doc_reference_question_unusual_label'] ELSE [] END ||
 CASE WHEN regexp_matches(q, 'phone|fax|email') AND field_type <> 'CONTACT' THEN ['contact_question_not_contact'] ELSE [] END ||
 CASE WHEN regexp_matches(q, '^when|date|time') AND field_type <> 'DATE_TIME' THEN ['date_time_question_unusual_label'] ELSE [] END ||
 CASE WHEN regexp_matches(a, '%\\s*$') AND field_type <> 'PERCENTAGE' THEN ['percent_answer_not_percentage'] ELSE [] END"""


@query(f"WITH {TYPED}, r0 AS (SELECT *, lower(question) AS q, answer AS a, ['DOCUMENT_REFERENCE', 'OTHER', 'CONTACT'][row_id % 3 + 1] AS field_type FROM typed), f AS (SELECT row_id, template, array_to_string({_FLAG_SQL}, '|') AS flags FROM r0) SELECT * FROM f WHERE flags <> ''")
def label_sanity_flags(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("DOCUMENT_REFERENCE"), F.lit("OTHER"), F.lit("CONTACT")), (F.col("row_id") % 3 + 1).cast("int"))
    q = F.lower("question")
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(F.array(
        flag(q.rlike("page|figure|table number") & (kind != "DOCUMENT_REFERENCE"), "doc_reference_question_unusual_label"), flag(q.rlike("phone|fax|email") & (kind != "CONTACT"), "contact_question_not_contact"),
        flag(q.rlike("^when|date|time") & (kind != "DATE_TIME"), "date_time_question_unusual_label"), flag(F.col("answer").rlike(r"%\s*$") & (kind != "PERCENTAGE"), "percent_answer_not_percentage"),
    ))
    return proxies.typed(spark, sf).select("row_id", "template", F.array_join(flags, "|").alias("flags")).where("flags <> ''")


@query(f"WITH {LABELS} SELECT split, row_id, field_type, CASE WHEN split = 'train' THEN rule_confidence END AS rule_confidence FROM lab")
def merge_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = proxies.labels(spark, sf)
    parts = [rows.where(F.col("split") == s).select("split", "row_id", "field_type", *(["rule_confidence"] if s == "train" else [])) for s in proxies.SPLITS]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


# Gold and predicted labels: quality marks against a rule on the text's length.
_GOLD = """gold AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS gold, toxic FROM labels), guess AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'odd' WHEN n_chars > 800 THEN 'good' ELSE 'poor' END AS predicted FROM documents WHERE lang <> 'es'),
 ev AS (SELECT g.doc_id, gold, predicted, toxic FROM gold g LEFT JOIN guess USING (doc_id))"""


def _gold(spark: SparkSession, sf: str, unmatched: str | None = None) -> DataFrame:
    """Predictions of German documents are known by another key only, and Spanish ones have none."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    gold = table(spark, sf, "labels").select("doc_id", name.alias("doc_name"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("gold"), "toxic")
    kind = F.when(F.col("n_chars") % 7 == 0, "odd").when(F.col("n_chars") > 800, "good").otherwise("poor")
    guess = table(spark, sf, "documents").where("lang <> 'es'").select(F.when(F.col("lang") != "de", F.col("doc_id")).alias("doc_id"), F.when(F.col("lang") == "de", name).alias("doc_name"), kind.alias("predicted"))
    return classification.joined_gold(gold, guess, ["doc_id", "doc_name"], unmatched)


@query(f"WITH {_GOLD} SELECT doc_id, gold, predicted FROM ev WHERE gold IS NOT NULL AND predicted IS NOT NULL")
def gold_eval_join(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf).where("gold IS NOT NULL AND predicted IS NOT NULL").select("doc_id", "gold", "predicted")


@query(f"WITH {_GOLD} SELECT toxic, count(*) AS n, avg(CASE WHEN gold = predicted THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM ev WHERE predicted IS NOT NULL GROUP BY toxic")
def gold_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf).where("predicted IS NOT NULL").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"))


@query(f"""WITH {_GOLD}, e AS (SELECT * FROM ev WHERE predicted IS NOT NULL), l AS (SELECT gold AS label FROM e UNION SELECT predicted FROM e),
 c AS (SELECT label, (SELECT count(*) FROM e WHERE gold = label) AS support, (SELECT count(*) FROM e WHERE predicted = label) AS named, (SELECT count(*) FROM e WHERE gold = label AND predicted = label) AS hit FROM l),
 m AS (SELECT label, coalesce(hit::DOUBLE / nullif(named, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, support FROM c),
 f AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM m)
SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""")
def gold_class_report(spark: SparkSession, sf: str) -> DataFrame:
    return classification.report(_gold(spark, sf))


@query(f"WITH {_GOLD} SELECT gold, coalesce(predicted, 'nan') AS predicted, count(*) AS n FROM ev GROUP BY ALL")
def gold_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Unmatched gold rows as a class of their own instead of left out."""
    return _gold(spark, sf, "nan").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GOLD} SELECT CASE WHEN grouping(gold) = 1 THEN 'All' ELSE gold END AS gold, CASE WHEN grouping(predicted) = 1 THEN 'All' ELSE predicted END AS predicted, count(*) AS n FROM ev WHERE predicted IS NOT NULL AND gold <> predicted GROUP BY CUBE (gold, predicted)")
def error_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return classification.crosstab(_gold(spark, sf).where("gold <> predicted"), "gold", "predicted")


@query("SELECT segment, count(*) AS n FROM (SELECT c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 13 <> 0 AND o_totalprice >= 20000 AND o_orderkey % 17 <> 0) GROUP BY segment")
def benchmark_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return joins.type_counts(_built(spark, sf).withColumnRenamed("c_mktsegment", "segment"), "segment")


@query(f"WITH {_GOLD}, e AS (SELECT * FROM ev WHERE predicted IS NOT NULL), l AS (SELECT gold AS label FROM e UNION SELECT predicted FROM e) SELECT g.label AS gold, p.label AS predicted, (SELECT count(*) FROM e WHERE gold = g.label AND predicted = p.label) AS n FROM l g, l p")
def gold_confusion(spark: SparkSession, sf: str) -> DataFrame:
    counts = _gold(spark, sf).where("predicted IS NOT NULL").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.col("gold").alias("label")).union(counts.select("predicted")).distinct()  # the taxonomy's labels
    grid = labels.select(F.col("label").alias("gold")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_GOLD} SELECT gold, predicted, count(*) AS n FROM ev WHERE gold <> predicted GROUP BY ALL ORDER BY n DESC")
def gold_error_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf).where("gold <> predicted").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(f"WITH {_GOLD} SELECT CASE WHEN grouping(gold) = 1 THEN 'All' ELSE gold END AS gold, CASE WHEN grouping(predicted) = 1 THEN 'All' ELSE predicted END AS predicted, count(*) AS n FROM ev WHERE predicted IS NOT NULL GROUP BY CUBE (gold, predicted)")
def sensitivity_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return classification.crosstab(_gold(spark, sf), "gold", "predicted")


@query(f"WITH {LABELS} SELECT row_id, field_type FROM lab WHERE row_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("row_id"))
    return joins.pending(proxies.labels(spark, sf).select("row_id", "field_type"), done, "row_id")


@query("""WITH b AS (SELECT o_orderkey, c_mktsegment AS segment, CASE WHEN o_orderkey % 13 = 0 THEN 'no_image' WHEN o_totalprice < 20000 THEN 'no_span' WHEN o_orderkey % 17 = 0 THEN 'no_box' ELSE 'kept' END AS outcome FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, segment, outcome FROM b""")
def benchmark_join(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).select("o_orderkey", F.col("c_mktsegment").alias("segment"), "outcome")


def _built(spark: SparkSession, sf: str) -> DataFrame:
    examples = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    labels = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.benchmark_rows(labels, examples, ["o_custkey"], F.col("o_totalprice") >= 20000, F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 17 != 0)


@query("""WITH b AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'no_image' WHEN o_totalprice < 20000 THEN 'no_span' WHEN o_orderkey % 17 = 0 THEN 'no_box' ELSE 'kept' END AS outcome FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT count(*) AS total_seen, count(*) FILTER (outcome = 'kept') AS total_kept, count(*) FILTER (outcome = 'no_span') AS skipped_no_span, count(*) FILTER (outcome = 'no_image') AS skipped_no_image, count(*) FILTER (outcome = 'no_box') AS skipped_no_bbox FROM b""")
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    return joins.summary(_built(spark, sf))


@query(f"""WITH {LABELS}, last AS (SELECT l_partkey AS row_id, max({{'at': l_orderkey * 10 + l_linenumber, 'flag': l_returnflag}}).flag AS flag FROM lineitem GROUP BY 1)
SELECT lab.row_id, split, coalesce(flag, 'OTHER') AS flag FROM lab LEFT JOIN last ON last.row_id = CASE WHEN lab.row_id % 7 = 0 THEN -lab.row_id ELSE lab.row_id END""")
def enrich_types(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    rows = proxies.labels(spark, sf).withColumn("key", F.when(F.col("row_id") % 7 == 0, -F.col("row_id")).otherwise(F.col("row_id")))  # some keys have no lines
    return joins.enrich(rows.select("row_id", "split", "key"), lines, "key", "flag", "at").drop("key")


@query("SELECT c_custkey, n_name, scenario FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (VALUES ('original'), ('ocr_drop'), ('ocr_mask')) t(scenario)")
def scenario_cross(spark: SparkSession, sf: str) -> DataFrame:
    names = F.explode(F.array(F.lit("original"), F.lit("ocr_drop"), F.lit("ocr_mask")))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nation, "c_nationkey").select("c_custkey", "n_name", names.alias("scenario"))


@query("""WITH l AS (SELECT l_orderkey AS k1, l_linenumber AS k2, {'at': l_shipdate, 'v': l_partkey} AS r FROM lineitem), a AS (SELECT k1, k2, max(r).v AS v FROM l GROUP BY 1, 2), b AS (SELECT k1, max(r).v AS v FROM l GROUP BY 1)
SELECT o_orderkey, coalesce(a.v, b.v) AS part FROM orders LEFT JOIN a ON o_orderkey = a.k1 AND a.k2 = o_orderkey % 9 + 1 LEFT JOIN b ON o_orderkey = b.k1""")
def lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("at"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("order"), (F.col("o_orderkey") % 9 + 1).alias("line"))  # not every order has so many lines
    return joins.lookup(rows, lines, [["order", "line"], ["order"]], "part", "at").select("o_orderkey", "part")


@query(f"WITH {QA}, m AS (SELECT question, answer, max(conv_id) AS found FROM qa GROUP BY ALL) SELECT qa.conv_id, qa.turn, m.found FROM qa JOIN m USING (question, answer)")
def qa_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = proxies.qa(spark, sf)
    key = rows.select("conv_id", "turn", F.md5(F.concat_ws("\x1f", "question", "answer")).alias("key"))
    found = key.groupBy("key").agg(F.max("conv_id").alias("found"))
    return key.join(found, "key").select("conv_id", "turn", "found")


@query("WITH ids AS (SELECT s_suppkey * 3 AS id, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS place FROM supplier) SELECT place, c_custkey, c_name FROM ids JOIN customer ON c_custkey = id")
def id_list_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = scenarios.row_index(table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("_order")), "_order").select((F.col("_order") * -3).alias("c_custkey"), F.col("row_index").alias("place"))
    return table(spark, sf, "customer").join(ids, "c_custkey").select("place", "c_custkey", "c_name")


_SAMPLE = "s AS (SELECT p_partkey, p_type, md5('42:' || CAST(p_partkey AS VARCHAR)) AS k FROM part), q AS (SELECT p_type, floor({n} / count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY p_type) - 1 < {n} % count(*) OVER () THEN {extra} ELSE 0 END AS quota FROM (SELECT DISTINCT p_type FROM s))"


def _ranked(n: int, order: str, extra: int = 1) -> str:
    return f"WITH {_SAMPLE.format(n=n, extra=extra)}, r AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.p_type ORDER BY {order}) AS rn FROM s JOIN q USING (p_type))"


def _backfill(n: int, order: str, extra: int = 1) -> str:
    return f"{_ranked(n, order, extra)}, a AS (SELECT * FROM r WHERE rn <= quota), b AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM r WHERE rn > quota) SELECT p_partkey, p_type FROM a UNION ALL SELECT p_partkey, p_type FROM b WHERE place <= {n} - (SELECT count(*) FROM a)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_type")


@query(_ranked(203, "k, p_partkey") + " SELECT p_partkey, p_type FROM r WHERE rn <= quota")
def stratified_quota(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota(_parts(spark, sf), "p_type", "p_partkey", 203)


@query(_backfill(503, "k, p_partkey"))
def stratified_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.backfilled(_parts(spark, sf), "p_type", "p_partkey", 503)


@query(_backfill(203, "p_partkey", 0))
def stratified_v1(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.backfilled(_parts(spark, sf), "p_type", "p_partkey", 203, seed=None, remainder=False)


@query(_backfill(203, "p_partkey"))
def stratified_v2(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.backfilled(_parts(spark, sf), "p_type", "p_partkey", 203, seed=None)


@query("SELECT p_partkey FROM part ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 200")
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_rows(table(spark, sf, "part").select("p_partkey"), "p_partkey", 200)


@query(f"WITH {LABELS}, r AS (SELECT row_id, field_type, row_number() OVER (PARTITION BY field_type ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM lab) SELECT row_id, field_type FROM r WHERE rn <= 10")
def audit_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.at_most(proxies.labels(spark, sf).select("row_id", "field_type"), "field_type", "row_id", 10)


