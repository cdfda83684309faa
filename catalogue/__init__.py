"""Queries over the driver tables, one per operator, with the SQL they must agree with."""

from catalogue import evidence, pages, plans, runs, texts, urls  # noqa: F401
from catalogue.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark, sf):
    return QUERIES["hygiene_readiness_by_host"](spark, sf)
