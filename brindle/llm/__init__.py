"""Training-data operators: cleaning, deduplication, tokenising, mixing and retrieval.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when present.
"""
