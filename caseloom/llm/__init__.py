"""Operators for training-data corpora: language, duplicates, personal data, secrets, tokens, quality. Nothing outside imports this."""
