"""Connected components of a link table, distributed: the library's own operator."""

from voxlake.operators.graph import components

__all__ = ["components"]
