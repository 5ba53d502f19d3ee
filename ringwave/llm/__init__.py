"""Operators for training-data pipelines, one module each; ``registry`` holds their queries."""
