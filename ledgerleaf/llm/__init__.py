"""Operators for preparing training data of language models, one module each, and their registered queries."""
