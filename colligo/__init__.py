"""Colligo: typed, nested collections on PySpark — queries, rules, sources and reports."""

from colligo.catalog import AmbiguousCollection, Catalog, UnknownCollection
from colligo.collection import Collection
from colligo.engine import Engine

__all__ = ["AmbiguousCollection", "Catalog", "Collection", "Engine", "UnknownCollection"]
