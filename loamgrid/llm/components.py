"""Connected components by joins, for graphs of any size."""

from loamgrid.operators.graph import components  # noqa: F401
