"""Training-data operators: extraction, filtering, de-duplication, tokenisation and formatting.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries when it is present.
"""
