"""Registered queries over the given tables."""

from __future__ import annotations


def load():
    """Import every plan module and return the filled registry."""
    from tidemark.plans import intake, models, panels, posts, ranking, scores  # noqa: F401
    from tidemark.plans.registry import QUERIES

    return QUERIES
