"""Integrity analytics on Spark: sample, record, model and distribution checks as DataFrame operators."""
