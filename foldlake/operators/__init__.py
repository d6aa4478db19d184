"""Operators over edit and item tables: reads, ranges, aggregates, ordered sequences, sets, sketches, scripts."""

from . import aggregates, ordered, ranges, read, script, sets, sketch  # noqa: F401
