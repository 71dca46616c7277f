"""Operators for training-data pipelines, one module a problem; `queries` registers them."""
