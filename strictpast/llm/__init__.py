"""Operators of a training-data pipeline: deduplication, tokens, languages, chats."""
