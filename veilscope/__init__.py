"""Document question answering: redaction, leak audits, scoring and membership statistics on Spark."""
