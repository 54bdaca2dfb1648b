"""Operators of a training-data pipeline: mixing, decontamination, chat, tokens, language, quality, URLs, duplicates, PII."""
