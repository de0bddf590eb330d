"""Operators for text training-data pipelines at corpus scale."""
