"""Tokens and required fields of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages of refused requests.
MISSING_HEADER = "Missing Authorization header"
BAD_HEADER = "Invalid Authorization header format. Expected: Bearer {token}"
BAD_TOKEN = "Invalid token format"
NO_USER = "Token missing userId"
NO_PROJECT = "projectId is required"
NO_ROOT = "merkleRoot is required"
NO_CHUNKS = "chunks array is required"
BAD_PHASE = "phase must be 1 or 2"
NO_TEXTS = "chunks array is required"
NO_LANGUAGE = "languageId is required"
NO_INPUT = "input is required"

BEARER, TOKEN = "Bearer ", "dev-token-"


def auth_error(header: Column) -> Column:
    """Why a header is refused (status 401); null where it isn't."""
    token = F.substr(header, F.lit(len(BEARER) + 1))
    return (
        F.when(header.isNull() | (header == ""), MISSING_HEADER)
        .when(~header.startswith(BEARER), BAD_HEADER)
        .when(~token.startswith(TOKEN), BAD_TOKEN)
        .when(F.length(token) == len(TOKEN), NO_USER)
    )


def user_of(header: Column) -> Column:
    """The user id of a good header, else null."""
    return F.when(auth_error(header).isNull(), F.substr(header, F.lit(len(BEARER) + len(TOKEN) + 1)))


def request_error(project: Column, root: Column, chunks: Column, phase: Column | None = None) -> Column:
    """Why a request is refused (status 400), the first reason in order; null where it isn't."""
    out = F.when(project.isNull() | (project == ""), NO_PROJECT).when(root.isNull() | (root == ""), NO_ROOT)
    if phase is not None:
        out = out.when(phase.isNull() | ~phase.isin(1, 2), BAD_PHASE)
    return out.when(chunks.isNull(), NO_CHUNKS)
