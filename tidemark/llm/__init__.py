"""Operators of a training-data pipeline; nothing else in tidemark imports this subpackage."""
