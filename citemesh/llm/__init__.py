"""Training-data operators: deduplication, search, language, mixing, sharding, extraction.

Nothing else in the library imports this subpackage; deleting the folder leaves the rest whole.
"""
