"""Expressions against plain Python and against values worked out by hand."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscope.functions import geometry, pixels, rules, scoring, spans, text
from veilscope.operators import checks, containment, joins, membership, metrics, plugins, ranges, report, sampling, scenarios
from veilscope.sources import manifests


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def normalized(x):
    return " ".join(re.sub(r"[^\w\s]", " ", x.lower()).split())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB é.,-_\n\t9ß", max_size=20), min_size=1, max_size=8))
def test_normalize_equals_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [normalized(r["t"]) for r in rows]


@pytest.mark.parametrize("prediction, gold, em, f1", [("the cat sat", "cat the dog", 0, 2 / 3), ("", "", 1, 1), ("a", "", 0, 0), ("a a b", "a b b", 0, 2 / 3), ("x", "y", 0, 0), ("$1.90", "$ 1 90", 1, 1)])
def test_scores(spark, prediction, gold, em, f1):
    row = one(spark, em=scoring.exact_match(F.lit(prediction), F.lit(gold)), f1=scoring.token_f1(F.lit(prediction), F.lit(gold)))
    assert row["em"] == em and row["f1"] == pytest.approx(f1)


def brute_spans(tokens, answer):
    flat = [(p, i) for i, t in enumerate(tokens) for p in normalized(t).split()]
    words, out = normalized(answer).split(), []
    for i in range(len(flat) - len(words) + 1):
        if words and [p for p, _ in flat[i : i + len(words)]] == words and (s := (flat[i][1], flat[i + len(words) - 1][1])) not in out:
            out.append(s)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "A,", "a-b", "...", "c"]), max_size=10), st.sampled_from(["a", "a b", "", "b a", "a a", "...", "c a b"]))
def test_spans_equal_brute_force(spark, tokens, answer):
    df = spark.createDataFrame([(tokens, answer)], "t array<string>, a string")
    found = df.select(spans.find_spans(spans.subtokens(F.col("t")), F.col("a")).alias("s")).first()["s"]
    assert [tuple(x) for x in found] == brute_spans(tokens, answer)


def test_redaction_and_context(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>")
    found = spans.find_spans(spans.subtokens(F.col("t")), F.lit("b c"))
    row = df.select(spans.redact(F.col("t"), found, "drop").alias("d"), spans.redact(F.col("t"), found, "mask").alias("m"), spans.expand(found, 1, F.size("t")).alias("e"), spans.redact(F.col("t"), found, "none").alias("n")).first()
    assert row["d"] == ["a", "d"] and row["m"] == ["a", "[REDACTED]", "[REDACTED]", "d"] and [tuple(x) for x in row["e"]] == [(0, 3)] and row["n"] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        spans.redact(F.col("t"), found, "shred")


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    row = one(spark, r=geometry.rectangle(box(0.5, 1.5, 2.5, 3.5)), p=geometry.rectangle(box(3, 1, 9, 2, 5, 8)), n=geometry.rectangle(box(1, 2, 3)), m=geometry.per_mille(box(0, 0, 320, 99999), F.lit(640), F.lit(480)))
    assert row["r"] == [0, 2, 2, 4] and row["p"] == [3, 1, 9, 8] and row["n"] is None and row["m"] == [0, 0, 500, 1000]


@pytest.mark.parametrize("question, answer, kind, sure", [
    ("Who is the chairperson?", "robert olson", "PERSON_NAME", 0.94), ("What is the name of the State ?", "Virginia", "CATEGORY_LABEL", 0.82), ("What was the timing for the 'official business' on 6/11 ?", "9AM to 5PM", "IDENTIFIER", 0.9),
    ("How much is the 'Expenditures' for Salaries account?", "$ 12,180.00", "MONEY", 1.0), ("Which Part of the application is this?", "II", "CATEGORY_LABEL", 0.82), ("What?", "", "OTHER", 1.0), ("Is it so?", "Yes", "BOOLEAN", 1.0),
    ("When was it?", "1999", "DATE_TIME", 0.98), ("how many stores?", "12", "QUANTITY", 0.97), ("What is the fax?", "555-123-4567", "CONTACT", 0.98), ("What?", "one; two three four 5", "FREE_TEXT", 0.8),
])
def test_rules(spark, question, answer, kind, sure):
    label = one(spark, x=rules.label(F.lit(question), F.lit(answer)))["x"]
    assert (label["field_type"], label["rule_confidence"]) == (kind, sure)


def test_rule_table_is_complete():
    assert len(rules.RULES) == 38


def test_auc_counts_ties_half_and_needs_both_classes(spark):
    rows = [("a", 1.0, True), ("a", 1.0, False), ("a", 2.0, True), ("a", 0.0, False), ("b", 1.0, True)]
    out = membership.auc(spark.createDataFrame(rows, "k string, s double, y boolean"), "s", F.col("y"), "k").collect()
    assert {r["k"]: r["auc"] for r in out} == {"a": (0.5 + 1 + 1 + 1) / 4, "b": None}


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0), (2.576, 1e7, 0.01)])
def test_p_values_equal_tables(t, df, p):
    assert membership.two_sided_p(t, df) == pytest.approx(p, abs=2e-4)
    assert membership.two_sided_p(None, df) is None


def test_masks_change_their_box_only():
    import numpy as np

    picture = np.random.default_rng(1).integers(1, 255, (12, 16, 3), np.uint8).tobytes()
    for strategy in ("black", "white", "blur"):
        out = np.frombuffer(pixels.mask_bytes(picture, 16, 12, [[2, 3, 9, 8]], strategy, 3.0), np.uint8).reshape(12, 16, 3)
        changed = (out != np.frombuffer(picture, np.uint8).reshape(12, 16, 3)).any(2)
        assert changed[3:8, 2:9].any() and not changed[:3].any() and not changed[8:].any() and not changed[:, :2].any() and not changed[:, 9:].any()
    assert pixels.mask_bytes(picture, 16, 12, None, "black", None) == picture
    with pytest.raises(ValueError):
        pixels.mask_bytes(picture, 16, 12, [], "shred", None)


def test_samples_are_stable_and_full(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 5, "rare").otherwise("common").alias("kind"))
    assert sampling.quota(df, "kind", "id", 20).count() == 15
    first = sampling.backfilled(df, "kind", "id", 20).collect()
    assert len(first) == 20 and sorted(first) == sorted(sampling.backfilled(df.repartition(7), "kind", "id", 20).collect())


def test_scenarios(spark):
    assert scenarios.grid(spark).count() == 35
    row = one(spark, a=scenarios.parse(F.lit("img_blur + nothing")), b=scenarios.parse(F.lit("")))
    assert row["a"]["error"] == "unsupported" and row["b"]["error"] == "unsupported"


def test_reasons_and_answers_have_fixed_values(spark):
    label = lambda q, a: one(spark, x=rules.label(F.lit(q), F.lit(a)))["x"]["rule_reason"]
    assert [label("What?", a) for a in ("", "a@b.org", "5 %", "none", "12", "one two three four five")] == ["empty_answer", "email_or_url_regex", "percentage_regex", "generic_short_label", "plain_numeric", "long_text_span"]
    parsed = lambda x: tuple(one(spark, x=text.parse_model_answer(F.lit(x)))["x"])
    assert parsed('{"other": "DATE"}') == ("OTHER", False) and parsed("{} DATE") == ("DATE", False) and parsed('{"field_type": "tax_id"}') == ("tax_id", True)
    assert one(spark, n=text.char_code_sum(F.lit("aé")), e=text.char_code_sum(F.lit(""))) == (97 + 233, 0)


def test_confidence_is_a_mean_log_probability(spark):
    logs = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    tokens = F.array(F.lit(5), F.lit(2), F.lit(7))
    row = one(spark, a=scoring.sequence_confidence(logs(-1.0, -3.0, -9.0), tokens, 2), b=scoring.sequence_confidence(logs(-1.0, -2.0, -3.0), tokens, 4), c=scoring.sequence_confidence(logs(), tokens, 2), d=scoring.sequence_confidence(logs(float("-inf")), tokens, 4))
    assert tuple(row) == (-2.0, -2.0, 0.0, -100.0)


def test_small_samples_have_fixed_statistics(spark):
    rows = spark.createDataFrame([("m", "seen", float(i), 1.0) for i in range(9)], "model string, split string, confidence double, loss double")
    out = membership.summary(rows, "model").first()
    assert (out["n_seen"], out["auc_confidence"], out["auc_loss"], out["mean_seen_conf"], out["std_unseen_conf"]) == (9, 0.5, 0.5, 0.0, 0.0)


def test_exact_means_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, -0.25, 1 / 3, 0.7] * 50 + [0.0000005]
    out = {spark.createDataFrame([(v,) for v in (values if i % 2 else values[::-1])], "v double").repartition(i + 1).agg(metrics.exact_mean("v").alias("m")).first()["m"] for i in range(6)}
    assert len(out) == 1 and out.pop() == pytest.approx(sum(values) / len(values), abs=1e-6)
    assert spark.range(0).agg(metrics.exact_mean("id").alias("m")).first()["m"] is None


def test_lookup_takes_the_last_row(spark):
    source = spark.createDataFrame([("a", 9, 1), ("a", 3, 2)], "k string, v int, at int")
    assert joins.lookup(spark.createDataFrame([("a",), ("b",)], "k string"), source, [["k"]], "v", "at").orderBy("k").collect() == [("a", 3), ("b", None)]


def test_redaction_of_any_spans(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(12):
        n = int(rng.integers(0, 9))
        words, found = [f"t{i}" for i in range(n)], [(int(a), int(b)) for a, b in rng.integers(0, 10, (int(rng.integers(0, 4)), 2))]
        inside = lambda i: any(a <= i <= b for a, b in found)  # noqa: B023, E731
        array = lambda xs, kind: F.array(*xs).cast(kind) if xs else F.array().cast(kind)
        t, s = array([*map(F.lit, words)], "array<string>"), array([F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in found], "array<struct<start:int,end:int>>")
        row = one(spark, d=spans.redact(t, s, "drop"), m=spans.redact(t, s, "mask"))
        assert row["d"] == [w for i, w in enumerate(words) if not inside(i)] and row["m"] == ["[REDACTED]" if inside(i) else w for i, w in enumerate(words)]


def test_tokens_are_normalised_one_by_one(spark):
    words = ["Ab-c", "--", "", "É\x01x", "ΑΣ", "ΑΣ,Β", "İ", "a\u2028b", " z "]
    each = [one(spark, x=text.normalize(F.translate(F.lit(w), "\x01", " ")))["x"] for w in words]
    assert one(spark, x=spans.normalized_tokens(F.array(*map(F.lit, words))))["x"] == each
    assert one(spark, x=spans.normalized_tokens(F.array().cast("array<string>")))["x"] == []


def test_files_of_pictures_are_decoded(spark, tmp_path):
    import struct

    import numpy as np

    rgb = np.random.default_rng(2).integers(0, 255, (5, 7, 3), np.uint8)
    ppm = b"P6\n# note\n7 5\n255\n" + rgb.tobytes()
    line = np.pad(rgb[::-1, :, ::-1].reshape(5, 21), ((0, 0), (0, 3))).tobytes()
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(line), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(line), 0, 0, 0, 0) + line
    for name, data in (("a.ppm", ppm), ("b.bmp", bmp), ("c.png", b"\x89PNG"), ("d.ppm", ppm[:-1])):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", pixels.decoded(F.col("content")).alias("p"))
    out = {r["path"][-5:]: r["p"] for r in files.collect()}
    for name in ("a.ppm", "b.bmp"):
        assert (out[name]["width"], out[name]["height"], bytes(out[name]["picture"])) == (7, 5, rgb.tobytes())
    assert out["c.png"]["picture"] is None and out["d.ppm"]["width"] is None
    wide = np.repeat(np.repeat(rgb, 4, 0), 4, 1)
    assert pixels.downscaled(wide.tobytes(), 28, 20, 7) == (7, 5, rgb.tobytes())


def test_exports_and_snapshots(spark, tmp_path):
    table = report.to_latex(spark.createDataFrame([("a_b & 5%", 0.5), (None, None)], "k string, v double"), "Some #1", "tab:x")
    assert r"a\_b \& 5\% & 0.5000 \\" in table and r"\caption{Some \#1}" in table
    import os

    for i, name in enumerate(("old", "new", "older")):
        spark.range(3).write.parquet(str(tmp_path / name))
        os.utime(tmp_path / name, (1000 + (50 if name == "new" else i), 1000 + (50 if name == "new" else i)))
    newest = manifests.newest_snapshot(spark, str(tmp_path))
    assert newest.endswith("/new") and manifests.read_shards(spark, newest).count() == 3
    assert manifests.newest_snapshot(spark, str(tmp_path / "none")) is None
    assert manifests.read_optional(spark, str(tmp_path / "none"), "a int", "csv").count() == 0
    assert manifests.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "old")).endswith("/old")


def test_checks(spark):
    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "id int, t string")
    out = {r["check"]: (r["passed"], r["failures"]) for r in checks.run_checks(df, {"t_full": checks.full("t")}).collect()}
    assert out == {"not_empty": (True, 0), "t_full": (False, 2)}
    empty = {r["check"]: r["passed"] for r in checks.run_checks(df.limit(0), {"t_full": checks.full("t")}).collect()}
    assert empty == {"not_empty": False, "t_full": True}


def test_markdown_sections_replace_themselves(spark):
    table = report.to_markdown(spark.createDataFrame([("a|b", 0.5)], "k string, v double"))
    once = report.replace_section("# T\n", "x", table)
    assert report.replace_section(once, "x", table) == once and "a\\|b" in once


def test_plugins(spark):
    class Echo:  # local, so that it travels to the workers by value
        def predict(self, records):
            return [f"{r['question']}!" for r in records]

    df = spark.createDataFrame([("When was it?", "1999"), ("date", "q7")], "question string, answer string")
    assert [r["prediction"] for r in plugins.predict(df, Echo).orderBy("question").collect()] == ["When was it?!", "date!"]
    out = {r["question"]: (r["field_type"], r["label_source"]) for r in plugins.label(df, Echo).collect()}
    assert out == {"When was it?": ("DATE_TIME", "rule"), "date": ("DATE_TIME", "llm")}
    pauses = []
    with pytest.raises(OSError):
        plugins.with_retries(lambda: open("/there/is/nothing"), 3, pause=pauses.append)
    assert pauses == [1.0, 2.0]


def test_auc_of_continuous_scores_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE", 50)
    draw = random.Random(5)
    rows = [("k" if i % 4 else None, draw.choice([draw.random(), draw.random() ** 9, 0.5]), i % 3 == 0) for i in range(900)]
    out = membership.auc(spark.createDataFrame(rows, "k string, s double, y boolean"), "s", F.col("y"), "k").collect()
    for r in out:
        high, low = ([s for k, s, y in rows if k == r["k"] and y == side] for side in (True, False))
        assert r["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low)), abs=1e-12)
    assert len(out) == 2


def test_positions_over_uneven_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE", 100)
    values = [i**5 - 40**5 for i in range(500)] + [2**40]
    out = scenarios.row_index(spark.createDataFrame([(v,) for v in values[::-1]], "v long").repartition(5), "v").collect()
    assert {r["v"]: r["row_index"] for r in out} == {v: i for i, v in enumerate(sorted(values))}
    spread = ranges.ranged(spark.createDataFrame([(v,) for v in values], "v long"), "v").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert spread < 60  # equal widths would put most of them in one
    assert scenarios.row_index(spark.createDataFrame([], "v long"), "v").count() == 0


def test_random_baseline_equals_brute_force(spark):
    draw = random.Random(3)
    answers = ["", "?!", "the the", "the", *(" ".join(draw.choices(["the", "of", "red", "box", "tea"], k=draw.randint(1, 6))) for _ in range(60))]
    rows = [(i, "ab"[i % 2], a) for i, a in enumerate(answers)] + [(-1, "alone", "the box")]
    out = {r["i"]: (r["random_em"], r["random_f1"]) for r in metrics.random_baseline(spark.createDataFrame(rows, "i long, p string, gold string"), ["p"]).collect()}

    def f1(a, b):
        a, b = Counter(normalized(a).split()), Counter(normalized(b).split())
        both = a.total() + b.total()
        return 1.0 if not both else 2 * (a & b).total() / both

    assert out.pop(-1) == (1.0, 1.0) and len(out) == len(answers)
    for i, pool, answer in rows[:-1]:
        others = [a for j, p, a in rows if p == pool and j != i]
        assert out[i][0] == pytest.approx(sum(normalized(a) == normalized(answer) for a in others) / len(others), abs=1e-8)
        assert out[i][1] == pytest.approx(sum(f1(a, answer) for a in others) / len(others), abs=1e-8)


def test_samples_equal_a_plain_ranking(spark):
    rows = [(i, "abc"[min(i % 5, 2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k string")
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    strata = {k: [r for r in order if r[1] == k] for k in "abc"}
    first = [r for n, k in enumerate("abc") for r in strata[k][: 700 + (n < 1)]]  # 2,101 rows, of which a and b have 600 each
    spare = [r for r in order if r not in set(first)][: 2101 - len(first)]
    assert {r["i"] for r in sampling.quota(df, "k", "i", 2101).collect()} == {i for i, _ in first}
    assert {r["i"] for r in sampling.backfilled(df, "k", "i", 2101).collect()} == {i for i, _ in first + spare}
    assert {r["i"] for r in sampling.at_most(df, "k", "i", 11).collect()} == {i for k in "abc" for i, _ in strata[k][:11]}


def test_passages_of_any_length_are_found(spark):
    texts = ["the cat sat on the mat", "The", "a cat; sat on", "", None, "on the mat the cat", "sat on the mat again"]
    passages = ["the", "the cat", "cat sat on", "sat on the mat", "sat on the mat again and again", "", None, "mat"]
    one_by_one = lambda x, name: spark.createDataFrame(list(enumerate(x)), f"{name} int, text string")
    found = {tuple(r) for r in containment.contained(one_by_one(texts, "t"), one_by_one(passages, "p"), "t", "p").select("t", "p").collect()}
    plain = lambda x: f" {normalized(x or '')} "
    assert found == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(passages) if normalized(y or "") and plain(y) in plain(x)}
    assert containment.contained(one_by_one(texts, "t"), one_by_one([], "p"), "t", "p").count() == 0
