"""Named queries and their DuckDB counterparts."""
