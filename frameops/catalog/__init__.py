"""Named queries over the given tables, each with the SQL that checks it."""

from frameops.catalog import answers, corpus, evaluation, plans, relational, sources  # noqa: F401
from frameops.catalog.registry import QUERIES, Query, Tables  # noqa: F401
