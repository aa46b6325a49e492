"""Training-data operators: token counts, fingerprints, de-duplication, filters, mixing and packing.

Nothing outside this package imports it.  ``queries`` names the registered queries.
"""
