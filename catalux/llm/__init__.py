"""Training-data operators and pipeline: one module per operator, queries in ``registry``."""
