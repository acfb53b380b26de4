"""A Spark-first analytics engine for long-lived conversation memory."""
