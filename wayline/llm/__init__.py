"""Operators of a training-data pipeline: archives, language, dedup, decontamination, tokens, chat, markup."""
