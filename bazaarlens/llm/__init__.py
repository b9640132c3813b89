"""Operators for preparing training data: ten operators on documents and conversations, and their queries."""
