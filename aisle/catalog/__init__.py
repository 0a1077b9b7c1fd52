"""Registered queries; importing the package fills the registry."""

from aisle.catalog import changes, fraud, sales, stock, streams  # noqa: F401
from aisle.catalog.registry import ENTRIES  # noqa: F401
