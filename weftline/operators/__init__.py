"""DataFrame operators: retrieval, deduplication, trees of paths, vectors, graphs, logs and pages."""
