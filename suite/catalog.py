"""All registered queries."""

from suite import archives, ranking, terms, texts, vectors  # noqa: F401
from suite.base import REGISTRY

__all__ = ["REGISTRY"]
