"""Queries over the given tables, each with the SQL it is checked against where SQL can say it."""

from paneleffect.registry.book import BOOK
from paneleffect.registry import checks, effects, features, learning, profile, storage  # noqa: F401

__all__ = ["BOOK"]
