"""Every registered query with its oracle."""

from portolan.queries import changes, documents, goods_quality, imports, registry, relational, reports, table_jobs  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
