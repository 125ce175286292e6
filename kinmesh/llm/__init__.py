"""Operators of a training-data pipeline: formatting, tokens, secrets, duplicates, language, quality."""
