"""Report tables: pivots, long forms, metric rows, and Markdown."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import exact_mean


def tagged_union(parts: dict[str, DataFrame], tag: str = "model") -> DataFrame:
    """Tables of several models below one another, with the model's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in parts.items()))


def pivot(df: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    """Mean of ``value`` by row and column; the columns' values and order are given, so one pass suffices."""
    return df.groupBy(rows).pivot(columns, values).agg(exact_mean(value))


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def metric_rows(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(key, metric, value): the ids that aren't empty joined by `` | ``; null values are left out."""
    named = df.select(F.concat_ws(" | ", *(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ids)).alias("key"), *(F.col(v).cast("double").alias(v) for v in values))
    return melt(named, ["key"], values).where("value IS NOT NULL")


def mode_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(exact_mean(value).alias(value))


def best_by(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """For each group the label with the highest mean value, ties by label."""
    means = df.groupBy(*keys, label).agg(exact_mean(value).alias(value))
    top = means.groupBy(*keys).agg(F.max(value).alias("_top"))
    tied = means.join(top, keys).where(F.col(value) == F.col("_top"))
    return tied.groupBy(*keys).agg(F.min(label).alias(label), F.max("_top").alias(value))


def scaling(df: DataFrame, parameters: Column) -> DataFrame:
    return df.withColumn("log_params", F.log10(parameters))


def to_markdown(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a report's first rows; reports are small by nature, and ``limit`` bounds them."""
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, row)) + " |" for row in df.limit(limit).collect())])


def replace_section(document: str, name: str, body: str) -> str:
    """``document`` with the section between the marks of ``name`` replaced, or appended; repeating it changes nothing."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    section = f"{begin}\n{body}\n{end}"
    head, found, rest = document.partition(begin)
    if not found:
        return f"{document.rstrip()}\n\n{section}\n" if document.strip() else section + "\n"
    return head + section + rest.partition(end)[2]


def to_latex(df: DataFrame, caption: str, label: str, limit: int = 200) -> str:
    """A LaTeX table of a report's first rows; reports are small by nature, and ``limit`` bounds them."""
    escaped = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x.replace("\\", r"\textbackslash ")).replace("~", r"\textasciitilde ").replace("^", r"\textasciicircum ")
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else escaped(str(v))
    lines = [" & ".join(map(escaped, df.columns)) + r" \\", r"\hline", *(" & ".join(map(shown, row)) + r" \\" for row in df.limit(limit).collect())]
    body = "\n".join(lines)
    return f"\\begin{{table}}\n\\caption{{{escaped(caption)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"
