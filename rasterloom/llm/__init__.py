"""Training-data operators: deduplication, quality, sharding, mixing and packing.

Nothing outside this package imports it; see ``queries.py`` for the registered
queries and ``corpus_pipeline.py`` at the repository top for the pipeline.
"""
