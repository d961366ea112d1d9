"""Whose rows are whose: projects belong to users, and two users may have projects of one id."""

from __future__ import annotations

from pyspark.sql import DataFrame


def owner(rows: DataFrame) -> list[str]:
    """The columns that name a project: ``user_id`` where rows have it, and ``project_id``."""
    return [c for c in ("user_id", "project_id") if c in rows.columns]


def file_key(rows: DataFrame) -> list[str]:
    """The columns that name a file."""
    return [*owner(rows), "relative_path"]
