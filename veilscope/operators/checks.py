"""Integrity checks of a manifest; each is a row of a table of checks, all counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import redact


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed, failures): how many rows fail each condition; a null counts as a failure."""
    counted = df.agg(F.count(F.lit(1)).alias("_all"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))
    rows = F.explode(F.array(F.struct(F.lit("not_empty").alias("check"), F.when(F.col("_all") > 0, 0).otherwise(1).cast("long").alias("failures")), *(F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks)))
    return counted.select(rows.alias("x")).select("x.check", (F.col("x.failures") == 0).alias("passed"), "x.failures")


def full(*columns: str) -> Column:
    """None of the columns is null or blank."""
    conditions = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in columns]
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


#: The columns of a manifest, and those that must not be blank.
MANIFEST_COLUMNS = (
    "dataset_name", "split", "local_row_id", "example_id", "question", "answer", "answers", "field_type", "coarse_field_type", "field_group", "sensitivity", "answer_start_idx", "answer_end_idx", "answer_bbox", "ocr_tokens", "image_path", "image_size",
)
MANIFEST_FULL = ("split", "example_id", "question", "answer", "field_type", "coarse_field_type", "image_path")


def manifest_checks(records: DataFrame, lines: DataFrame, images: DataFrame, total_kept: int | None) -> DataFrame:
    """(check, passed, failures) of a manifest: its raw ``lines`` (``value``), its ``records``, the ``images`` that exist
    (``path``, ``readable``) and the number of records that the summary of its build names.

    Records are checked in one pass and by one join with the images; every record is checked, not a sample."""
    missing = missing_columns(records, list(MANIFEST_COLUMNS))
    there = records.withColumns({c: F.lit(None).cast("string") for c in missing})
    words = F.transform("ocr_tokens", lambda t: t["text"]) if "ocr_tokens" not in missing else F.array().cast("array<string>")
    start, end = F.col("answer_start_idx").cast("int"), F.col("answer_end_idx").cast("int")
    span = F.array(F.struct(start.alias("start"), end.alias("end")))
    n = F.size(words)
    dropped = F.concat(F.slice(words, F.lit(1), F.greatest(start, F.lit(0))), F.slice(words, end + 2, F.greatest(n - end - 1, F.lit(0))))
    masked = F.slice(redact(words, span, "mask"), start + 1, F.greatest(end - start + 1, F.lit(0)))
    size = F.col("image_size")
    valid = {
        "manifest_required_fields_non_empty": full(*MANIFEST_FULL),
        "manifest_image_sizes_valid": (F.size(size) == 2) & F.forall(size, lambda v: v > 0) if "image_size" not in missing else F.lit(False),
        "ocr_drop_removes_answer_span": redact(words, span, "drop") == dropped,
        "ocr_mask_replaces_with_redacted": (F.size(masked) > 0) & F.forall(masked, lambda t: t == fixed.MASK_TEXT),
    }
    by_record = run_checks(there, valid).withColumn("check", F.regexp_replace("check", "^not_empty$", "manifest_not_empty"))
    paths = there.groupBy(F.col("image_path").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    known = paths.join(images.select("path", "readable", F.lit(True).alias("exists")), "path", "left")
    counted = known.agg(
        F.count_if(F.col("exists").isNull()).alias("original_images_exist"), (F.coalesce(F.sum(F.col("n") - 1), F.lit(0)) + F.count_if(F.col("exists").isNull())).alias("manifest_matches_real_original_files"),
        F.count_if(~F.col("readable")).alias("original_images_readable"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"),
    )
    summary = counted.withColumn("summary_matches_manifest_count", F.abs(F.col("_n") - F.lit(-1 if total_kept is None else total_kept)))
    blank = lines.agg(F.count_if(F.trim("value") == "").alias("manifest_no_blank_lines"))
    columns = summary.crossJoin(F.broadcast(blank)).withColumn("manifest_expected_columns", F.lit(len(missing)).cast("long"))  # one row each
    names = ["original_images_exist", "manifest_matches_real_original_files", "original_images_readable", "summary_matches_manifest_count", "manifest_no_blank_lines", "manifest_expected_columns"]
    rows = columns.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("failures")) for c in names))).alias("x")).select("x.check", (F.col("x.failures") == 0).alias("passed"), "x.failures")
    return by_record.unionByName(rows)
