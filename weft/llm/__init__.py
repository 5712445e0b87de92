"""Operators for training-data pipelines (language-model scoring, dedup, PII, tokens)."""
