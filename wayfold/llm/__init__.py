"""Training-data operators: personal data, token counts, encoding, search, quality,
URL filters, near-duplicates, packing and chat formatting.

Nothing outside this folder imports it; it can be removed as a whole.
"""
