"""Training-data operators: one module for each, queries in ``entries``."""
