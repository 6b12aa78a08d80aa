"""Driver queries: one function and, where SQL can say it, one oracle per name."""

from queries.registry import ORACLES, QUERIES  # noqa: F401
from queries import (  # noqa: F401  (modules register their queries on import)
    assure_queries,
    dataset_queries,
    export_queries,
    frontier_queries,
    markup_queries,
    ops_queries,
    process_queries,
    view_queries,
)
