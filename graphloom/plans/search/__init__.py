"""A small boolean search language over nodes and edges, compiled to Columns."""

from graphloom.plans.search.compiler import search
from graphloom.plans.search.parser import parse, validate

__all__ = ["parse", "search", "validate"]
