"""Connected components, for the operators that group what they link."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["components"]
