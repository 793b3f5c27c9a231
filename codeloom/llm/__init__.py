"""Training-data operators: sharding, language ID, deduplication, scans, search, token files.

Nothing outside this subpackage imports it.
"""
