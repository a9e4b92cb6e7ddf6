"""Registered queries."""

from . import cases, deeper, more, queries, text, wider  # noqa: F401
