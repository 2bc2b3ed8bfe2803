"""Operators for large-scale training data, and their registered queries (``llm.queries``)."""
