"""Training-data operators: packing, classifiers, tokenization, sharding, near-duplicates, search, PII and URL rules.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
