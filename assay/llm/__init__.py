"""Operators of a training-data pipeline; nothing else of the library imports this subpackage."""
