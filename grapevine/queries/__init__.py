"""Queries over the given tables, each with the SQL it must agree with where SQL can express it."""

from . import (  # noqa: F401
    clusters, evaluation, ingest, measures, models, replies, samples, sources, stages, streams, trends,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
