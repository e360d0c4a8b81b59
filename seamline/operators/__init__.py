"""DataFrame operators: relations, graphs, co-occurrence, comparison."""
