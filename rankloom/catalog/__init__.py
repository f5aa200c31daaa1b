"""Every operator as a query over the driver tables."""

from rankloom.catalog import (  # noqa: F401
    blend_queries,
    item_queries,
    learner_queries,
    metric_queries,
    scalar_queries,
    stat_queries,
    window_queries,
)
from rankloom.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
