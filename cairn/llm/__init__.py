"""Training-data operators: quality, near duplicates, contamination, chat, licences, tokens, language, PII, mixing.

Nothing else in the library imports this subpackage.
"""
