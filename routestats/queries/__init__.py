"""The operators bound to the star-schema test tables, each with its DuckDB check where SQL can say it."""

from routestats.queries import analytics, cleaning, modeling, relational, statistics  # noqa: F401
from routestats.queries.registry import REGISTRY  # noqa: F401
