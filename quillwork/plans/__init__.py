"""Queries over the driver's tables; importing this package registers them."""

from . import auditing, comparing, diffing, grouping, joining, marking, ordering, overlaying, searching, shaping, viewing  # noqa: F401
