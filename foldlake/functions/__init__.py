"""Scalar functions over columns."""

from . import hashes, numbers, values  # noqa: F401
