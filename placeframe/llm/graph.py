"""Connected components, as in the rest of the library."""

from placeframe.operators.graph import components

__all__ = ["components"]
