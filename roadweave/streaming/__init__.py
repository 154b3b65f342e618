"""Structured Streaming jobs: the batch operators on streams, plus keyed state where it is needed."""
