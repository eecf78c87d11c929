"""Views of the driver's tables in the roles of the engine's inputs, in Spark and as SQL for other engines.

``labels``: label rows from ``part``; ``qa``: question and answer from neighbouring turns of ``conversations``;
``own``: documents with their tokens and an answer cut from these; ``typed``: templated questions with answers from the
star tables; ``predictions``: scored rows from ``part``; ``scores``: confidence and loss from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import subtokens
from .registry import table

TYPES = list(fixed.TAXONOMY)
_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
SPLITS = ["train", "validation", "test"]


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("row_id"), pick(SPLITS, F.col("p_size") % 3).alias("split"), pick(TYPES, F.col("p_partkey") % len(TYPES)).alias("field_type"),
        F.concat(F.lit("What is the name of the "), F.lower("p_type"), F.lit("?")).alias("question"), F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.col("p_name")).alias("answer"),
        pick(["llm", "rule", "rule", "rule", "error"], F.col("p_size") % 5).alias("label_source"), ((F.col("p_size") % 10) / 10).alias("rule_confidence"),
    )


LABELS = f"""lab AS (
  SELECT p_partkey AS row_id, ['train', 'validation', 'test'][p_size % 3 + 1] AS split, {_TYPES_SQL}[p_partkey % {len(TYPES)} + 1] AS field_type,
         'What is the name of the ' || lower(p_type) || '?' AS question, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS answer,
         ['llm', 'rule', 'rule', 'rule', 'error'][p_size % 5 + 1] AS label_source, (p_size % 10)::DOUBLE / 10 AS rule_confidence
  FROM part)"""
TAXONOMY = "tax(field_type, coarse, sensitivity, field_group) AS (VALUES " + ", ".join(f"('{t}', {f"'{c}'" if c else 'NULL'}, '{s}', '{g}')" for t, (c, s, g) in fixed.TAXONOMY.items()) + ")"


def qa(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    return c.withColumn("answer", F.lead("text").over(w)).where((F.col("role") == "user") & F.col("answer").isNotNull()).select("conv_id", "turn", F.col("text").alias("question"), "answer")


QA = """qa AS (SELECT conv_id, turn, text AS question, answer FROM (
  SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user' AND answer IS NOT NULL)"""


def own(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda t: t != "").alias("tokens")).where(F.size("tokens") > 0)
    return d.withColumn("answer", F.array_join(F.slice("tokens", (F.col("doc_id") % F.size("tokens") + 1).cast("int"), (F.col("doc_id") % 3 + 1).cast("int")), " "))


def own_flat(spark: SparkSession, sf: str) -> DataFrame:
    return own(spark, sf).withColumn("flat", subtokens(F.col("tokens")))


OWN = r"""own AS (
  SELECT *, array_to_string(toks[doc_id % len(toks) + 1 : doc_id % len(toks) + 1 + doc_id % 3], ' ') AS answer FROM (
    SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda t: t <> '') AS toks FROM documents WHERE text IS NOT NULL) WHERE len(toks) > 0)"""
#: Sub-tokens in rows: doc, place among the document's sub-tokens, part, token index.
SUB = (
    OWN
    + f""", tok AS (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS token FROM own),
  sub AS (SELECT doc_id, token, part, row_number() OVER (PARTITION BY doc_id ORDER BY token, k) AS place FROM (
    SELECT doc_id, token, unnest(string_split(n, ' ')) AS part, generate_subscripts(string_split(n, ' '), 1) AS k FROM (SELECT doc_id, token, {norm_sql("t")} AS n FROM tok)) WHERE part <> ''),
  ans AS (SELECT doc_id, string_split({norm_sql("answer")}, ' ') AS words FROM own WHERE {norm_sql("answer")} <> ''),
  want AS (SELECT doc_id, len(words) AS n, unnest(words) AS part, generate_subscripts(words, 1) - 1 AS k FROM ans),
  span AS (SELECT DISTINCT s.doc_id, f.token AS s, l.token AS e FROM (
      SELECT w.doc_id, u.place - w.k AS begin, any_value(w.n) AS n FROM want w JOIN sub u ON u.doc_id = w.doc_id AND u.part = w.part GROUP BY ALL HAVING count(*) = any_value(w.n)) s
    JOIN sub f ON f.doc_id = s.doc_id AND f.place = s.begin JOIN sub l ON l.doc_id = s.doc_id AND l.place = s.begin + s.n - 1)"""
)

#: (key column, table, question, answer) of the templates, as SQL that both engines read.
TEMPLATES = [
    ("c_custkey", "customer", "'Who is the client?'", "replace(c_name, '#', ' ')"),
    ("c_custkey", "customer", "'What is the account number?'", "c_name"),
    ("c_custkey", "customer", "'What type of segment is it?'", "c_mktsegment"),
    ("s_suppkey", "supplier", "'What is the name of the company?'", "replace(s_name, '#', ' no ')"),
    ("s_suppkey", "supplier", "'What is the phone number?'", "concat('555-0', cast(s_suppkey + 1000 as varchar(20)))"),
    ("p_partkey", "part", "concat('What is the heading of page ', cast(p_size as varchar(20)), '?')", "p_name"),
    ("p_partkey", "part", "'How many cartons are there?'", "cast(p_size as varchar(20))"),
    ("p_partkey", "part", "'What is the cost?'", "concat('$', cast(p_size as varchar(20)), '.50')"),
    ("p_partkey", "part", "'What percentage is it?'", "concat(cast(p_size as varchar(20)), ' %')"),
    ("p_partkey", "part", "'Which city is it?'", "p_brand"),
    ("o_orderkey", "orders", "'When was the order placed?'", "substr(cast(o_orderdate as varchar(30)), 1, 4)"),
    ("o_orderkey", "orders", "'What is the page number?'", "cast(o_orderkey as varchar(20))"),
    ("o_orderkey", "orders", "'Is it urgent?'", "case when o_orderpriority like '1%' then 'Yes' else 'No' end"),
    ("o_orderkey", "orders", "'What does it say?'", "concat('priority ', o_orderpriority, ' with status ', o_orderstatus)"),
    ("n_nationkey", "nation", "'Who wrote it?'", "n_name"),
    ("n_nationkey", "nation", "'What is the address?'", "concat('1234', cast(n_nationkey as varchar(20)))"),
]
TYPED_SELECT = " UNION ALL ".join(f"SELECT cast({k} as bigint) AS row_id, {i} AS template, {q} AS question, {a} AS answer FROM {{{t}}}" for i, (k, t, q, a) in enumerate(TEMPLATES))
TYPED = "typed AS (" + TYPED_SELECT.format(**{t: t for _, t, _, _ in TEMPLATES}) + ")"


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TYPED_SELECT.format(**{t: f"parquet.`{sf}/{t}.parquet`" for _, t, _, _ in TEMPLATES}))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Gold names with the name of another part as prediction, for three scenarios."""
    p = table(spark, sf, "part")
    other = p.select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("_name"))
    ids = p.withColumn("_k", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).otherwise(F.expr("p_partkey div 2")))
    joined = ids.join(other.select("_k", "_name"), "_k")
    scenario = F.explode(F.array(F.lit("original"), F.lit("img_black"), F.lit("img_blur_20")))
    base = joined.select(
        F.col("p_partkey").alias("example_id"), F.when(F.col("p_size") % 2 == 0, "seen").otherwise("unseen").alias("split"), F.col("p_type").alias("coarse_type"),
        F.col("p_name").alias("gold"), F.array("p_name", "p_brand").alias("answers"), F.col("_name").alias("named"), scenario.alias("scenario"),
    )
    return base.withColumn("prediction", F.when(F.col("scenario") == "original", F.col("named")).when((F.col("scenario") == "img_black") & (F.col("example_id") % 4 == 0), F.upper("gold")).when(F.col("scenario") == "img_blur_20", F.concat(F.col("named"), F.lit(" gear"))).otherwise("")).drop("named")


PREDICTIONS = """pred AS (
  SELECT example_id, split, coarse_type, gold, answers, scenario,
         CASE WHEN scenario = 'original' THEN named WHEN scenario = 'img_black' AND example_id % 4 = 0 THEN upper(gold) WHEN scenario = 'img_blur_20' THEN named || ' gear' ELSE '' END AS prediction
  FROM (SELECT p.p_partkey AS example_id, CASE WHEN p.p_size % 2 = 0 THEN 'seen' ELSE 'unseen' END AS split, p.p_type AS coarse_type, p.p_name AS gold, [p.p_name, p.p_brand] AS answers,
               o.p_name AS named, unnest(['original', 'img_black', 'img_blur_20']) AS scenario
        FROM part p JOIN part o ON o.p_partkey = CASE WHEN p.p_partkey % 3 = 0 THEN p.p_partkey ELSE p.p_partkey // 2 END))"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Membership scores; some are null, NaN or infinite."""
    e = table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(F.col("event_id") % 89 == 0, F.lit(float("nan"))).when(F.col("event_id") % 83 == 0, F.lit(float("inf")))
    return e.select(
        F.col("event_id").alias("example_id"), F.when(F.col("user_id") % 2 == 0, "seen").otherwise("unseen").alias("split"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.col("event_type").alias("field_type"), F.when(odd.isNull() & (F.col("event_id") % 97 != 0), F.bround("value", 0)).otherwise(odd).alias("confidence"), (F.col("value") + F.col("user_id") % 2).alias("loss"),
    )


SCORES = """sc AS (
  SELECT event_id AS example_id, CASE WHEN user_id % 2 = 0 THEN 'seen' ELSE 'unseen' END AS split, 'm' || CAST(user_id % 3 AS VARCHAR) AS model, event_type AS field_type,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 83 = 0 THEN 'Infinity'::DOUBLE ELSE round_even(value, 0) END AS confidence,
         value + user_id % 2 AS loss FROM events),
  fin AS (SELECT * FROM sc WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND NOT isinf(confidence) AND loss IS NOT NULL)"""
