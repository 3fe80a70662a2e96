"""Training-data operators: deduplication, tokenisation, language ID, mixing and record output.

Nothing outside this folder imports it; `queries.py` holds the registered queries.
"""
