"""Operators of a training-data pipeline, each usable on any table with the named columns."""
