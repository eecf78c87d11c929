"""Queries over sources, text expressions, ids, labels and scenario names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import scenarios
from . import proxies
from .registry import query, table


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS shard FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def scan_union_shards(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("shard"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("shard")))


@query(f"""WITH {proxies.LABELS}, {proxies.TAXONOMY}
SELECT row_id, split, coarse, question, answer FROM lab JOIN tax USING (field_type)
WHERE split IN ('train', 'validation') AND coarse IN ('DATE', 'AMOUNT', 'PERSON') AND trim(answer) <> '' AND trim(question) <> ''""")
def labels_scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = scenarios.with_taxonomy(proxies.labels(spark, sf))
    kept = rows.where(F.col("split").isin("train", "validation") & F.col("coarse").isin("DATE", "AMOUNT", "PERSON") & (text.strip(F.col("answer")) != "") & (text.strip(F.col("question")) != ""))
    return kept.select("row_id", "split", "coarse", "question", "answer")


@query(f"WITH {proxies.LABELS}, {proxies.TAXONOMY} SELECT row_id, field_type, coarse, sensitivity, field_group FROM lab LEFT JOIN tax USING (field_type)")
def label_taxonomy_map(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.with_taxonomy(proxies.labels(spark, sf)).select("row_id", "field_type", "coarse", "sensitivity", "field_group")


_SCENARIOS = """scen AS (
  SELECT 'original' AS scenario_id, 'none' AS ocr_strategy, 'none' AS image_strategy, 0 AS context_window, NULL::DOUBLE AS blur_sigma
  UNION ALL SELECT 'ocr_' || o || '__img_' || i || coalesce('_' || CAST(CAST(s AS INT) AS VARCHAR), '') || '__k_' || k, o, i, k, s
  FROM (VALUES (0), (20)) a(k), (VALUES ('none'), ('drop'), ('mask')) b(o), (VALUES ('none', NULL), ('black', NULL), ('white', NULL), ('blur', 10.0::DOUBLE), ('blur', 20.0), ('blur', 50.0)) c(i, s)
  WHERE NOT (o = 'none' AND i = 'none'))"""


@query(f"WITH {_SCENARIOS} SELECT * FROM scen")
def scenario_grid(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.grid(spark)


@query(f"WITH {_SCENARIOS} SELECT scenario_id, TRY_CAST(nullif(regexp_extract(scenario_id, 'blur_(\\d+)', 1), '') AS INT) AS sigma FROM scen")
def blur_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.grid(spark).select("scenario_id", scenarios.sigma(F.col("scenario_id")).alias("sigma"))


_PARSE_INPUTS = ["original", " img_black ", "ocr_mask_k20", "img_black+ocr_drop_k0", "img_white+ocr_mask_k0+img_blur_50", "ocr_mask__img_blur_20__k_20", "ocr_none__img_black__k_0", "ocr_drop__img_none__k_7", "img_black+what", "nonsense"]


@query("""SELECT p_partkey, scenario_id, image_id, ocr_id, context_window, error FROM part JOIN (VALUES (0, 'original', 'original', 'original', 0, NULL), (1, ' img_black ', 'img_black', 'original', 0, NULL), (2, 'ocr_mask_k20', 'original', 'ocr_mask_k20', 20, NULL), (3, 'img_black+ocr_drop_k0', 'img_black', 'ocr_drop_k0', 0, NULL), (4, 'img_white+ocr_mask_k0+img_blur_50', 'img_blur_50', 'ocr_mask_k0', 0, NULL), (5, 'ocr_mask__img_blur_20__k_20', 'img_blur_20', 'ocr_mask_k20', 20, NULL), (6, 'ocr_none__img_black__k_0', 'img_black', 'ocr_none', 0, NULL), (7, 'ocr_drop__img_none__k_7', 'original', 'ocr_drop_k7', 7, NULL), (8, 'img_black+what', NULL, NULL, NULL, 'unsupported'), (9, 'nonsense', NULL, NULL, NULL, 'unsupported'))
 t(i, scenario_id, image_id, ocr_id, context_window, error) ON i = p_partkey % 10""")
def scenario_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = scenarios.parse(F.col("scenario_id"))
    rows = table(spark, sf, "part").select("p_partkey", _pick(_PARSE_INPUTS).alias("scenario_id"))
    return rows.select("p_partkey", "scenario_id", parsed["image_id"].alias("image_id"), parsed["ocr_id"].alias("ocr_id"), parsed["context_window"].alias("context_window"), parsed["error"].alias("error"))


@query(f"SELECT doc_id, md5({proxies.norm_sql('text')}) AS norm FROM documents")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, md5({proxies.squeeze_sql('lower(text)')}) AS norm FROM documents")
def norm_ws_lower(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.squeeze_lower(F.col("text"))).alias("norm"))


@query(f"SELECT page_id, md5({proxies.squeeze_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS norm FROM pages")
def norm_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.without_tags(F.col("html"))).alias("norm"))


_ANSWERS = "CASE WHEN conv_id % 5 = 0 THEN ['  ', answer] WHEN conv_id % 5 = 1 THEN [] ELSE [question, answer, question] END"


def _with_answers(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.array().cast("array<string>")
    answers = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("  "), F.col("answer"))).when(F.col("conv_id") % 5 == 1, blank).otherwise(F.array("question", "answer", "question"))
    return proxies.qa(spark, sf).withColumn("answers", answers)


@query(f"WITH {proxies.QA} SELECT conv_id, turn, coalesce(list_filter(list_transform({_ANSWERS}, lambda x: trim(x)), lambda x: x <> '')[1], '') AS answer FROM qa")
def select_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _with_answers(spark, sf).select("conv_id", "turn", text.select_answer(F.col("answers")).alias("answer"))


@query(f"WITH {proxies.QA} SELECT conv_id, turn, coalesce(({_ANSWERS})[1], answer, '') AS answer FROM qa")
def first_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _with_answers(spark, sf).select("conv_id", "turn", text.first_answer(F.col("answers"), F.col("answer")).alias("answer"))


@query(f"WITH {proxies.QA} SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (0, 1) OR answer = question THEN [trim(answer)] ELSE [trim(answer), trim(question)] END AS candidates FROM qa")
def answer_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _with_answers(spark, sf).select("conv_id", "turn", text.answer_candidates(F.col("answer"), F.col("answers")).alias("candidates"))


@query(f"WITH {proxies.QA} SELECT conv_id, turn, md5(concat_ws('|||', 'talk', 'train', CAST(turn AS VARCHAR), {proxies.squeeze_sql('question')}, {proxies.squeeze_sql('answer')})) AS example_id FROM qa")
def example_id_md5(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.qa(spark, sf).select("conv_id", "turn", text.example_id(F.lit("talk"), F.lit("train"), F.col("turn"), F.col("question"), F.col("answer")).alias("example_id"))


_RAW_LABELS = [*fixed.LABEL_ALIASES, *fixed.TAXONOMY, " date ", "'money'.", "person_name!", "unknown thing", "", "Org"]
_RAW_SQL = "raw AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '  ' || r || '. ' WHEN 1 THEN r ELSE lower(r) END AS raw FROM (SELECT p_partkey, p_size, [" + ", ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" for x in _RAW_LABELS) + f"][p_partkey % {len(_RAW_LABELS)} + 1] AS r FROM part))"
_ALIAS_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in fixed.LABEL_ALIASES.items())
_TYPE_LIST = ", ".join(f"'{t}'" for t in fixed.TAXONOMY)


def _pick(values: list, key: str = "p_partkey") -> Column:
    """The value that a key falls on, in turn."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of parts as models write them: padded, as they are, or in lower case."""
    r, kind = _pick(_RAW_LABELS), F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", F.when(kind == 0, F.concat(F.lit("  "), r, F.lit(". "))).when(kind == 1, r).otherwise(F.lower(r)).alias("raw"))


@query(f"""WITH {_RAW_SQL}, al(a, b) AS (VALUES {_ALIAS_VALUES}), v AS (SELECT p_partkey, raw, upper(trim(regexp_replace(trim(raw), '[`"''.,:;!?]+', '', 'g'))) AS v FROM raw)
SELECT p_partkey, raw, CASE WHEN v IN ({_TYPE_LIST}) THEN v ELSE coalesce(b, 'OTHER') END AS label FROM v LEFT JOIN al ON a = v""")
def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_labels(spark, sf).select("p_partkey", "raw", text.normalize_label(F.col("raw")).alias("label"))


@query(f"""WITH {_RAW_SQL}, v AS (SELECT p_partkey, raw, regexp_replace(trim(raw), '[`"''.,:;!?\\s]+', '', 'g') AS v FROM raw)
SELECT p_partkey, raw, CASE WHEN upper(v) IN ({_TYPE_LIST}) THEN upper(v) WHEN regexp_matches(lower(v), '^[a-z][a-z0-9_]*$') THEN lower(v) ELSE 'OTHER' END AS label,
       upper(v) NOT IN ({_TYPE_LIST}) AND regexp_matches(lower(v), '^[a-z][a-z0-9_]*$') AS is_new FROM v""")
def label_normalize_pilot(spark: SparkSession, sf: str) -> DataFrame:
    label = text.normalize_label_pilot(F.col("raw"))
    return _raw_labels(spark, sf).select("p_partkey", "raw", label["label"].alias("label"), label["is_new"].alias("is_new"))


#: Answers of a model, the label that each must give, and whether it is a new one; ``@`` stands for the part's size.
_MODEL_ANSWERS = [
    ('{"field_type": "DATE"}', "DATE", False), ('Sure: {"field_type": "OTHER", "new_type": "box_code"} done @', "OTHER", False), ('{"field_type": "code_@"}', "code_@", True),
    ('{"field_type": "", "new_type": "rate_@"}', "rate_@", True), ("it is an amount of @, I think", "AMOUNT", False), ("no idea about @", "OTHER", False), ("", "OTHER", False), ('{"field_type": "Not Good", "new_type": "Bad"}', "OTHER", False),
    ("{broken json DATE @", "DATE", False), ('{"other": "DATE"}', "OTHER", False), ("{} or PHONE", "PHONE", False), ('{"field_type": null, "new_type": "tax_@"}', "tax_@", True), ('{"field_type": "ORG", "why": {"a": [1, 2]}}', "ORG", False),
]


@query("SELECT p_partkey, replace(raw, '@', CAST(p_size AS VARCHAR)) AS raw, replace(label, '@', CAST(p_size AS VARCHAR)) AS label, is_new FROM part JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}', {str(c).lower()})" for i, (a, b, c) in enumerate(_MODEL_ANSWERS)) + f") t(i, raw, label, is_new) ON i = p_partkey % {len(_MODEL_ANSWERS)}")
def parse_llm_json(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.replace(_pick([a for a, _, _ in _MODEL_ANSWERS]), F.lit("@"), F.col("p_size").cast("string"))
    label = text.parse_model_answer(F.col("raw"))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", label["label"].alias("label"), label["is_new"].alias("is_new"))


@query(f"""WITH {proxies.QA} SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 2 THEN {proxies.squeeze_sql('question')}
 ELSE trim(regexp_extract({proxies.squeeze_sql("regexp_replace('<p>Question: ' || question || '</p>', '<[^>]+>', ' ', 'g')")}, '(?i)Question:\\s*(.*)', 1)) END AS question FROM qa""")
def extract_question(spark: SparkSession, sf: str) -> DataFrame:
    q, third = F.col("question"), F.col("conv_id") % 3
    found = text.extract_question(F.when(third == 0, q), F.when(third == 1, q), F.when(third == 2, F.concat(F.lit("<p>Question: "), q, F.lit("</p>"))))
    return proxies.qa(spark, sf).select("conv_id", "turn", found.alias("question"))


@query(f"""WITH {proxies.QA} SELECT conv_id, turn, md5('<DocVQA>' || question) AS prompt_md5,
 md5('{{"messages":[{{"role":"user","content":' || to_json(question) || '}},{{"role":"assistant","content":' || to_json(answer) || '}}]}}') AS chat_md5 FROM qa""")
def prompt_records(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages")))
    return proxies.qa(spark, sf).select("conv_id", "turn", F.md5(F.concat(F.lit("<DocVQA>"), F.col("question"))).alias("prompt_md5"), F.md5(chat).alias("chat_md5"))


@query("SELECT page_id, list_last(string_split(replace(CASE WHEN page_id % 2 = 0 THEN url ELSE replace(url, '/', '\\') END, '\\', '/'), '/')) AS name FROM pages")
def path_basename(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit("/"), F.lit("\\")))
    return table(spark, sf, "pages").select("page_id", text.basename(path).alias("name"))


@query("""WITH s AS (SELECT p_partkey, p_size * 37 AS w, (p_partkey % 50 + 1) * 61 AS h FROM part)
SELECT p_partkey, CAST(greatest(1, round_even(w * least(1.0::DOUBLE, 1024::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS width, CAST(greatest(1, round_even(h * least(1.0::DOUBLE, 1024::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS height FROM s""")
def thumb_size(spark: SparkSession, sf: str) -> DataFrame:
    size = text.thumb_size(F.col("p_size") * 37, (F.col("p_partkey") % 50 + 1) * 61)
    return table(spark, sf, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer")
def row_index(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.row_index(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: unicode(c))) AS BIGINT) AS code_sum FROM part")
def char_code_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.char_code_sum(F.col("p_name")).alias("code_sum"))
