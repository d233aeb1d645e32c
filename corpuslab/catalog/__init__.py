"""All registered queries. Importing this package fills the registry."""

from corpuslab.catalog import (  # noqa: F401
    graph_queries,
    grid_queries,
    io_queries,
    learning_queries,
    profile_queries,
    relational_queries,
    search_queries,
    text_queries,
)
from corpuslab.catalog.registry import ORACLES, QUERIES  # noqa: F401
