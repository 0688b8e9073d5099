"""Training-data operators: encoding, mixing, pseudonyms, chat, WARC, toxicity,
deduplication, quality rules, similarity join and document fingerprints.

Nothing else in the library imports this subpackage.
"""
