from . import queries, graph_queries, record_queries, source_queries, spectral_queries  # noqa: F401  they fill the catalog
