"""Indexes: their files and versions, ingestion, and the plan of a query against one."""

from .index import Index, create, delete_index, open_index  # noqa: F401
from .ingest import ingest  # noqa: F401
