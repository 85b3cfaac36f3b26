"""Import every query module so that it registers itself."""

from . import (  # noqa: F401
    scalar_queries, page_queries, match_queries, project_queries, extract_queries, verify_queries,
    structure_queries, catalog_queries, populate_queries, stream_queries,
)
