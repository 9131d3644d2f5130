"""Training-data operators: fingerprints, extraction, quality, sharding, tokens, licences, duplicates, mixing, toxicity.

Nothing else in the library imports this subpackage.
"""
