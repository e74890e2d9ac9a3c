"""Training-data operators: one module each, with its query; ``catalog`` collects the queries."""
