"""Connected components for the operators of this subpackage; see ``kerbside.operators.components``."""

from kerbside.operators.components import components

__all__ = ["components"]
