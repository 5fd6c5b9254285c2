"""Every operator as a query on the test tables, with the same result in SQL."""

from plotflux.catalog import (  # noqa: F401
    cleaning,
    contrasts,
    flagship,
    joining,
    models,
    parsing,
    rollups,
    soils,
)
from plotflux.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
