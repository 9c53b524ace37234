"""Operators of a training-data pipeline. Nothing else in siteloom imports this subpackage."""
