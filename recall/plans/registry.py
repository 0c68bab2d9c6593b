"""All registered queries: batch operators, card files and streams."""

from __future__ import annotations


def all_queries() -> dict[str, tuple]:
    from recall.plans import file_queries, queries, stream_queries  # noqa: F401  (register on import)
    return dict(queries.QUERIES)
