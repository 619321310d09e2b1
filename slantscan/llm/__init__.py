"""Training-data pipeline operators: extraction, identification, filtering,
near-duplicate removal, mixing, packing, search, archives and chat formatting.

Nothing else in the library imports this package.
"""
