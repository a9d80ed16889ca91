"""Training-data operators: sharding, selection, deduplication, archives, media, chat and tokens.

Nothing else in the library imports this package.
"""
