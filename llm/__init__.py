"""Training-data operators: extraction, language, duplicates, tokens, mixing, search.

Nothing outside this package imports it; ``llm.registry`` lists its queries.
"""
