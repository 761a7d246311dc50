"""Training-data operators: deduplication, mixing, language and toxicity
scoring, decontamination, chat rendering, sharding and quality rules.

Nothing else in the library imports this package.
"""
