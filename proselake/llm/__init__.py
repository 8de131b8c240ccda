"""Training-data operators: near-duplicates, packing, repeats, token counts, decontamination, shards, quality, binary ids, URL filters, licenses.

Nothing outside this subpackage imports it.
"""
