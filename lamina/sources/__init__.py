"""Readers and writers."""

from lamina.sources.tables import spread, table

__all__ = ["spread", "table"]
