"""The named queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from . import claims, commerce, corroborated, desk, documents, dossiers, drafts, editorial, events, links, listings, matching, names, pages, patents, records, relational, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "claims", "commerce", "corroborated", "desk", "documents", "dossiers", "drafts", "editorial", "events", "links", "listings", "matching", "names", "pages", "patents", "records", "relational", "streams"]
