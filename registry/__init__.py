"""Queries over the test tables, each with the SQL it is checked against where SQL can say it."""

from registry import (  # noqa: F401
    cleaning,
    datasets,
    evaluation,
    features,
    jobs,
    monitoring,
    snapshots,
    tables,
    temporal,
)
from registry.base import ORACLES, QUERIES  # noqa: F401
