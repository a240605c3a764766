"""Operators for large training-data pipelines; `registry.QUERIES` holds their registered queries."""
