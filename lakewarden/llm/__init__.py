"""Training-data operators: near copies, overlaps, percentiles, repair, redaction, leaks, mixing and splitting.

Only this subpackage and ``tests/llm`` know these operators; the rest of the library imports nothing from here.
"""
