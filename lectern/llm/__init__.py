"""Training-data operators: deduplication, mixing, tokens, media, language, toxicity.

Nothing outside this subpackage imports it.
"""
