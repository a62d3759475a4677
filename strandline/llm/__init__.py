"""Training-data operators: de-duplication, privacy, media, archives, packing, filtering.

Nothing outside this subpackage imports it.
"""
