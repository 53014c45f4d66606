"""Operators for preparing training data: text, pages and vectors at corpus scale."""
