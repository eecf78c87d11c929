"""Queries over token arrays, spans, redaction and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, geometry, spans
from ..functions.text import normalize
from ..operators import containment, render, scenarios
from . import proxies
from .proxies import OWN, SUB
from .registry import query, table

_SPANS = SUB + ", arr AS (SELECT doc_id, list({'s': s, 'e': e} ORDER BY s, e) AS spans, len(any_value(toks)) AS n FROM span JOIN own USING (doc_id) GROUP BY doc_id)"


def _flat_struct(c: Column) -> Column:
    """Spans as arrays of starts and ends, which all engines compare alike."""
    return F.transform(c, lambda s: s["start"])


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type || '  x', ' ') AS b FROM part)
SELECT p_partkey, list_filter(list_concat(a, b), lambda t: t <> '') AS texts, len(list_filter(list_concat(a, b), lambda t: t <> '')) AS n FROM p""")
def tokens_flatten(spark: SparkSession, sf: str) -> DataFrame:
    box = F.array(F.col("p_size").cast("double"))
    word = lambda c: F.transform(F.split(c, " "), lambda w: F.struct(w.alias("text"), F.lit(None).cast("array<double>").alias("bounding_box"), box.alias("bbox")))
    lines = F.array(F.struct(word(F.col("p_name")).alias("words")), F.struct(word(F.concat(F.col("p_type"), F.lit("  x"))).alias("words")))
    tokens = spans.flatten_tokens(lines)
    return table(spark, sf, "part").select("p_partkey", F.transform(tokens, lambda t: t["text"]).alias("texts"), F.size(tokens).cast("long").alias("n"))


@query(f"WITH {SUB} SELECT doc_id, md5(string_agg(part, ' ' ORDER BY place)) AS parts, count(*) AS n, max(token) AS last FROM sub GROUP BY doc_id")
def subtokens(spark: SparkSession, sf: str) -> DataFrame:
    flat = proxies.own_flat(spark, sf).where(F.size("flat") > 0)
    return flat.select("doc_id", F.md5(F.array_join(F.transform("flat", lambda p: p["part"]), " ")).alias("parts"), F.size("flat").cast("long").alias("n"), F.array_max(F.transform("flat", lambda p: p["token"])).cast("long").alias("last"))


@query(f"WITH {_SPANS} SELECT doc_id, coalesce(list_transform(spans, lambda x: x.s), []) AS starts, coalesce(list_transform(spans, lambda x: x.e), []) AS ends FROM own LEFT JOIN arr USING (doc_id)")
def find_all_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = proxies.own_flat(spark, sf).select("doc_id", spans.find_spans(F.col("flat"), F.col("answer")).alias("s"))
    return found.select("doc_id", F.transform("s", lambda x: x["start"].cast("long")).alias("starts"), F.transform("s", lambda x: x["end"].cast("long")).alias("ends"))


@query(f"WITH {_SPANS} SELECT doc_id, spans[1].s AS start, spans[1].e AS end_, spans IS NOT NULL AS found FROM own LEFT JOIN arr USING (doc_id)")
def find_first_span(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(spans.find_spans(F.col("flat"), F.col("answer")), F.lit(0))
    return proxies.own_flat(spark, sf).select("doc_id", first.alias("f")).select("doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end_"), F.col("f").isNotNull().alias("found"))


def _candidates() -> Column:
    return F.array_distinct(F.array("answer", F.get("tokens", F.lit(0)), F.lit("zzzz")))


@query(f"""WITH {SUB}, first AS (SELECT doc_id, string_split({proxies.norm_sql('toks[1]')}, ' ') AS words FROM own WHERE {proxies.norm_sql('toks[1]')} <> ''),
 w1 AS (SELECT doc_id, len(words) AS n, unnest(words) AS part, generate_subscripts(words, 1) - 1 AS k FROM first),
 more AS (SELECT DISTINCT s.doc_id, f.token AS s, l.token AS e FROM (SELECT w.doc_id, u.place - w.k AS begin, any_value(w.n) AS n FROM w1 w JOIN sub u ON u.doc_id = w.doc_id AND u.part = w.part GROUP BY ALL HAVING count(*) = any_value(w.n)) s
   JOIN sub f ON f.doc_id = s.doc_id AND f.place = s.begin JOIN sub l ON l.doc_id = s.doc_id AND l.place = s.begin + s.n - 1),
 u AS (SELECT doc_id, s, e FROM span UNION SELECT doc_id, s, e FROM more)
SELECT doc_id, count(u.s) AS n, CAST(coalesce(sum(u.s), 0) AS BIGINT) AS starts, CAST(coalesce(sum(u.e), 0) AS BIGINT) AS ends FROM own LEFT JOIN u USING (doc_id) GROUP BY doc_id""")
def span_union(spark: SparkSession, sf: str) -> DataFrame:
    u = proxies.own_flat(spark, sf).select("doc_id", spans.union_of_spans(F.col("flat"), _candidates()).alias("u"))
    total = lambda f: F.aggregate(F.transform("u", lambda s: s[f].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return u.select("doc_id", F.size("u").cast("long").alias("n"), total("start").alias("starts"), total("end").alias("ends"))


def _with_spans(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.own_flat(spark, sf).withColumn("spans", spans.find_spans(F.col("flat"), F.col("answer")))


@query(f"""WITH {_SPANS}, w AS (SELECT DISTINCT doc_id, greatest(s - 20, 0) AS s, least(e + 20, len(toks) - 1) AS e FROM span JOIN own USING (doc_id))
SELECT doc_id, count(w.s) AS n, CAST(coalesce(sum(w.s), 0) AS BIGINT) AS starts, CAST(coalesce(sum(w.e), 0) AS BIGINT) AS ends FROM own LEFT JOIN w USING (doc_id) GROUP BY doc_id""")
def expand_spans(spark: SparkSession, sf: str) -> DataFrame:
    u = _with_spans(spark, sf).select("doc_id", spans.expand(F.col("spans"), 20, F.size("tokens")).alias("u"))
    total = lambda f: F.aggregate(F.transform("u", lambda s: s[f].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return u.select("doc_id", F.size("u").cast("long").alias("n"), total("start").alias("starts"), total("end").alias("ends"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [p_size, p_size + 5] WHEN p_size % 3 = 1 THEN [p_size] ELSE [] END AS starts FROM part""")
def record_spans(spark: SparkSession, sf: str) -> DataFrame:
    size, none = F.col("p_size"), F.lit(None).cast("int")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    many = F.when(size % 3 == 0, F.array(span(size, size + 1), span(none, none), span(size + 5, size + 6)))
    single = F.when(size % 3 == 1, size)
    return table(spark, sf, "part").select("p_partkey", _flat_struct(spans.record_spans(many, single, single + 2)).alias("starts"))


def _redacted_sql(expression: str) -> str:
    return f"""WITH {SUB}, hit AS (SELECT DISTINCT t.doc_id, t.i FROM (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM span) t),
 k AS (SELECT t.doc_id, t.token, t.t, h.i IS NOT NULL AS inside FROM tok t LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.i = t.token)
SELECT own.doc_id, md5(coalesce(string_agg({expression}, ' ' ORDER BY token), '')) AS tokens, count({expression}) AS n FROM own LEFT JOIN k USING (doc_id) GROUP BY own.doc_id"""


def _redacted(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    out = _with_spans(spark, sf).select("doc_id", spans.redact(F.col("tokens"), F.col("spans"), strategy).alias("r"))
    return out.select("doc_id", F.md5(F.array_join("r", " ")).alias("tokens"), F.size("r").cast("long").alias("n"))


@query(_redacted_sql("t"))
def redact_none(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(spark, sf, "none")


@query(_redacted_sql("CASE WHEN NOT inside THEN t END"))
def redact_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(spark, sf, "drop")


@query(_redacted_sql("CASE WHEN inside THEN '[REDACTED]' ELSE t END"))
def redact_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _redacted(spark, sf, "mask")


@query(f"WITH {OWN} SELECT doc_id, md5(array_to_string(toks, ' ')) AS text_md5 FROM own")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.array(F.lit("  ")), F.transform("tokens", lambda t: F.concat(F.lit(" "), t)))
    return proxies.own(spark, sf).select("doc_id", F.md5(spans.joined(padded)).alias("text_md5"))


_LEAK_SQL = f"""WITH {SUB}, hit AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM span),
 scen(scenario) AS (VALUES ('none'), ('drop'), ('mask')),
 left_ AS (SELECT c.scenario, s.doc_id, s.token, s.part, row_number() OVER (PARTITION BY c.scenario, s.doc_id ORDER BY s.place) AS place FROM (
   SELECT sub.*, h.i IS NOT NULL AS inside FROM sub LEFT JOIN hit h ON h.doc_id = sub.doc_id AND h.i = sub.token) s CROSS JOIN scen c WHERE c.scenario = 'none' OR NOT s.inside
   ), gap AS (SELECT c.scenario, l.*, 0 AS x FROM left_ l JOIN scen c USING (scenario)),
 again AS (SELECT DISTINCT g.scenario, g.doc_id, g.place - w.k AS begin, w.n, count(*) AS m, min(g.token) AS lo, max(g.token) AS hi FROM want w JOIN left_ g ON g.doc_id = w.doc_id AND g.part = w.part GROUP BY g.scenario, g.doc_id, g.place - w.k, w.n HAVING count(*) = w.n),
 ok AS (SELECT DISTINCT scenario, a.doc_id FROM again a WHERE scenario <> 'mask' OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = a.doc_id AND h.i BETWEEN a.lo AND a.hi))
SELECT scen.scenario, o.lang, count(*) AS checked, count(ok.doc_id) AS leaks, count(ok.doc_id) = 0 AS passed
FROM own o JOIN ans USING (doc_id) CROSS JOIN scen LEFT JOIN ok ON ok.doc_id = o.doc_id AND ok.scenario = scen.scenario GROUP BY ALL"""


@query(_LEAK_SQL)
def audit_ocr_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Redact every answer, look for it again, and count leaks by scenario and language."""
    return containment.leak_audit(proxies.own(spark, sf).where(normalize(F.col("answer")) != ""), ["lang"])


_BLANK = {"black": "false", "white": "n_chars % 40 = 0", "blur": "n_chars % 60 = 0"}
_FACTS = f"""{SUB}, rec AS (SELECT own.*, documents.n_chars, [own.answer, toks[1]] AS answers FROM own JOIN documents USING (doc_id) WHERE {proxies.norm_sql('own.answer')} <> ''),
 grid(scenario_id, ocr, image, k) AS (VALUES {', '.join(f"('ocr_{o}__img_{i}{b}__k_{k}', '{o}', '{i}', {k})" for k in fixed.CONTEXT_WINDOWS for o in fixed.OCR_STRATEGIES for i, b in (("none", ""), ("black", ""), ("white", ""), ("blur", "_10"), ("blur", "_20"), ("blur", "_50")) if (o, i) != ("none", "none"))}),
 h AS (SELECT DISTINCT doc_id, k, unnest(range(greatest(s - k, 0), least(e + k, len(toks) - 1) + 1)) AS i FROM span JOIN own USING (doc_id), (VALUES (0), (20)) w(k)),
 tn AS (SELECT doc_id, token, {proxies.norm_sql('t')} AS n FROM tok),
 j AS (SELECT o.ocr, w.k, tn.doc_id, ' ' || coalesce(string_agg(CASE WHEN h.i IS NULL AND n <> '' THEN n WHEN h.i IS NOT NULL AND o.ocr = 'mask' THEN 'redacted' END, ' ' ORDER BY token), '') || ' ' AS txt
   FROM tn CROSS JOIN (VALUES (0), (20)) w(k) CROSS JOIN (VALUES ('drop'), ('mask')) o(ocr) LEFT JOIN h ON h.doc_id = tn.doc_id AND h.i = tn.token AND h.k = w.k GROUP BY ALL),
 leak AS (SELECT j.ocr, j.k, j.doc_id FROM j JOIN rec USING (doc_id) WHERE contains(txt, ' ' || {proxies.norm_sql('answers[1]')} || ' ') OR ({proxies.norm_sql('answers[2]')} <> '' AND contains(txt, ' ' || {proxies.norm_sql('answers[2]')} || ' '))),
 still AS (SELECT doc_id, image FROM rec, LATERAL (VALUES {', '.join(f"('{i}', {c})" for i, c in _BLANK.items())}) t(image, same) WHERE same),
 fail AS (SELECT scenario_id, doc_id FROM grid JOIN leak USING (ocr, k) UNION SELECT scenario_id, doc_id FROM grid JOIN still USING (image)),
 res AS (SELECT scenario_id, ocr AS ocr_strategy, image AS image_strategy, k AS context_window, CASE WHEN ocr <> 'none' THEN (SELECT count(*) FROM rec) ELSE 0 END AS ocr_checked, (SELECT count(*) FROM leak WHERE leak.ocr = grid.ocr AND leak.k = grid.k) AS ocr_leaks,
   CASE WHEN image <> 'none' THEN (SELECT count(*) FROM rec) ELSE 0 END AS image_checked, (SELECT count(*) FROM still WHERE still.image = grid.image) AS image_unchanged,
   coalesce((SELECT list(doc_id ORDER BY doc_id) FROM fail WHERE fail.scenario_id = grid.scenario_id), [])[1:20] AS example_failures FROM grid)"""


@query(f"WITH {_FACTS} SELECT *, ocr_leaks = 0 AND image_unchanged = 0 AS passed, (SELECT sum(ocr_leaks + image_unchanged) = 0 FROM res) AS all_passed FROM res")
def audit_scenarios_full(spark: SparkSession, sf: str) -> DataFrame:
    """Every scenario over every document: its answer and its first token may not be found again; pictures of some
    lengths are blank, so that white or blurred boxes look as before."""
    chars = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = proxies.own(spark, sf).where(normalize(F.col("answer")) != "").join(chars, "doc_id").withColumn("answers", F.array("answer", F.get("tokens", F.lit(0))))
    return containment.scenario_audit(rows, scenarios.grid(spark), "doc_id", {image: F.expr(same) for image, same in _BLANK.items()})


@query(r"""WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [p_size + 0.5, p_size + 1.5, p_size + 10.5, p_size + 12.25] WHEN 1 THEN [p_size, 1.0, p_size + 9.0, 1.0, p_size + 9.0, 7.5, p_size, 7.5] WHEN 2 THEN [0.25, 0.5, 0.75, 1.0] ELSE [1.0, 2.0, 3.0] END::DOUBLE[] AS box FROM part),
c AS (SELECT p_partkey, CASE WHEN len(box) = 4 THEN box WHEN len(box) = 8 THEN [list_min([box[1], box[3], box[5], box[7]]), list_min([box[2], box[4], box[6], box[8]]), list_max([box[1], box[3], box[5], box[7]]), list_max([box[2], box[4], box[6], box[8]])] END AS c FROM b),
d AS (SELECT p_partkey, CASE WHEN list_max(c) <= 1 THEN [c[1] * 200, c[2] * 100, c[3] * 200, c[4] * 100] ELSE c END AS c FROM c)
SELECT p_partkey, list_transform(c, lambda v: CAST(round_even(v, 0) AS BIGINT)) AS box FROM d""")
def bbox_xyxy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", geometry.rectangle(_boxes(), F.lit(200.0), F.lit(100.0)).alias("box"))


def _boxes() -> Column:
    s, kind = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    array = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(float(x)) for x in xs))
    return F.when(kind == 0, array(s + 0.5, s + 1.5, s + 10.5, s + 12.25)).when(kind == 1, array(s, 1, s + 9, 1, s + 9, 7.5, s, 7.5)).when(kind == 2, array(0.25, 0.5, 0.75, 1)).otherwise(array(1, 2, 3))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE [p_size, 2, p_size + 3 * (p_size % 4), 10 + p_size % 4]::BIGINT[] END AS box FROM part""")
def span_bbox(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array((s + 3 * (i - 1)).cast("double"), F.lit(2.0), (s + 3 * i).cast("double"), (10 + i).cast("double"))))
    return table(spark, sf, "part").select("p_partkey", geometry.span_box(boxes, F.lit(0), (s % 4).cast("int")).alias("box"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN [0, 0, 0, 0] ELSE list_transform([p_size, 2 * p_size, 3 * p_size, 40 * p_size], lambda v: CAST(greatest(0, least(1000, round_even(1000.0::DOUBLE * v / 640, 0))) AS BIGINT)) END::BIGINT[] AS box FROM part")
def bbox_1000(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    box = F.when(F.col("p_size") % 5 != 0, F.array(s, 2 * s, 3 * s, 40 * s))
    return table(spark, sf, "part").select("p_partkey", geometry.per_mille(box, F.lit(640.0), F.lit(640.0)).alias("box"))


_NORM_ITEM, _NORM_DOC = proxies.norm_sql("b.text"), proxies.norm_sql("d.text")


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON {_NORM_ITEM} <> '' AND contains(' ' || {_NORM_DOC} || ' ', ' ' || {_NORM_ITEM} || ' ')")
def leak_documents(spark: SparkSession, sf: str) -> DataFrame:
    return containment.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query(f"WITH {_SPANS} SELECT count(*) AS total_checked, count(arr.doc_id) AS matched, count(arr.doc_id)::DOUBLE / count(*) AS match_rate FROM own LEFT JOIN arr USING (doc_id)")
def match_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = F.size(spans.find_spans(F.col("flat"), F.col("answer"))) > 0
    out = proxies.own_flat(spark, sf).agg(F.count(F.lit(1)).alias("total_checked"), F.count_if(found).alias("matched"))
    return out.withColumn("match_rate", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("total_checked")), F.lit(0.0)))


assert fixed.MASK_TEXT == "[REDACTED]"  # as in the SQL above


@query(f"WITH {_SPANS} SELECT doc_id, arr.doc_id IS NOT NULL AS found, coalesce(spans[1].s, -1) AS start, coalesce(spans[1].e, -1) AS end_ FROM own LEFT JOIN arr USING (doc_id) ORDER BY doc_id LIMIT 20")
def match_rate_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty records of a match rate, with their first spans."""
    first = F.get(spans.find_spans(F.col("flat"), F.col("answer")), F.lit(0))
    some = proxies.own_flat(spark, sf).orderBy("doc_id").limit(20).select("doc_id", first.alias("f"))
    place = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(-1)).cast("long")
    return some.select("doc_id", F.col("f").isNotNull().alias("found"), place("start").alias("start"), place("end").alias("end_"))


# Twelve tokens in three lines of four; a token's box is 8 wide and 6 high.
_PAGE = "tok AS (SELECT i, 10 * (i % 4) AS x, 8 * (i // 4) AS y FROM (SELECT unnest(range(12)) AS i)), rec AS (SELECT p_partkey, p_size % 12 AS s, least(p_size % 12 + p_size % 2, 11) AS e, p_partkey % 3 AS k FROM part)"


def _page(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("int")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.array(*(v.cast("double") for v in (10 * (i % 4), 8 * F.floor(i / 4), 10 * (i % 4) + 8, 8 * F.floor(i / 4) + 6))))
    span = F.struct((size % 12).alias("start"), F.least(size % 12 + size % 2, F.lit(11)).alias("end"))
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("k"), boxes.alias("boxes"), F.array(span).alias("spans"), F.unhex(F.repeat(F.lit("646464"), 40 * 24)).alias("picture"), F.lit(40).alias("width"), F.lit(24).alias("height"))


@query(f"WITH {_PAGE} SELECT p_partkey, [[min(x), min(y), max(x) + 8, max(y) + 6]]::BIGINT[][] AS boxes FROM rec JOIN tok ON i BETWEEN s AND e GROUP BY p_partkey")
def span_bboxes(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf).select("p_partkey", geometry.span_boxes(F.col("boxes"), F.col("spans")).alias("boxes"))


@query(f"""WITH {_PAGE}, b AS (SELECT p_partkey, (max(x) + 8 - min(x)) * (max(y) + 6 - min(y)) AS area FROM rec JOIN tok ON i BETWEEN greatest(s - k, 0) AND least(e + k, 11) GROUP BY p_partkey)
SELECT p_partkey, strategy, CAST(CASE WHEN strategy IN ('black', 'white') THEN area ELSE 0 END AS BIGINT) AS changed FROM b CROSS JOIN (VALUES ('none'), ('black'), ('white'), ('blur')) t(strategy)""")
def render_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Grey pages with an answer masked in its context; how many pixels have changed."""
    pages = _page(spark, sf).withColumn("strategy", F.explode(F.array(*map(F.lit, ("none", "black", "white", "blur")))))
    grey = F.length(F.hex("rendered")) - F.length(F.replace(F.hex("rendered"), F.lit("64"), F.lit("")))
    return render.rendered(pages, F.col("strategy"), F.col("k")).select("p_partkey", "strategy", (F.lit(40 * 24) - grey / 6).cast("long").alias("changed"))
