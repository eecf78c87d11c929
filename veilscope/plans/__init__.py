"""Queries over the driver's tables; importing this package registers them."""

from . import label_queries, metric_queries, report_queries, span_queries, text_queries  # noqa: F401
