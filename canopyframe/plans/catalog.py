"""All registered queries and their SQL equivalents."""

from . import queries_io, queries_space, queries_stats  # noqa: F401
from .bind import ORACLES, QUERIES  # noqa: F401
