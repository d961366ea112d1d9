"""Content addresses and vector ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(relative_path: Column, content: Column) -> Column:
    """SHA-256 of the path followed by the content, as hex."""
    return F.sha2(F.concat(relative_path, content), 256)


def chunk_hash(text: Column) -> Column:
    """SHA-256 of the text alone: equal code anywhere has one address."""
    return F.sha2(text, 256)


def vector_id(user: Column, project: Column, hash_: Column, full: bool = False) -> Column:
    """Tenant-qualified id; ``full`` keeps whole components, else 8, 8 and 16 characters, which may collide."""
    if full:
        return F.concat_ws("_", user, project, hash_)
    return F.concat_ws("_", F.substring(user, 1, 8), F.substring(project, 1, 8), F.substring(hash_, 1, 16))


def hash_of_vector_id(id_: Column) -> Column:
    """The third ``_``-separated part, or the whole id where there is none."""
    return F.coalesce(F.nullif(F.get(F.split(id_, "_"), F.lit(2)), F.lit("")), id_)
