"""Queries over the shared tables, one per operator, with SQL twins."""

from .base import QUERIES, SQL, Tables
from . import catalog, jobs, streams, validation, web, work  # noqa: F401

__all__ = ["QUERIES", "SQL", "Tables"]
