"""Training-data operators: language, quality, duplicates, secrets, tokens, media, packing.

Nothing outside this package imports it.
"""
