"""Models trained and applied with Spark ML (and one isolation forest built as a Spark job)."""
