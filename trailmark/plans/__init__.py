"""Query catalogue over the driver tables: every query with its SQL, by topic."""

from __future__ import annotations

from . import capture, learning, projects, review, sessions, text, windows, writes
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "capture", "learning", "projects", "review", "sessions", "text", "windows", "writes"]
