"""Training-data operators: near-duplicate detection, search, extraction, filtering and tokenisation.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
