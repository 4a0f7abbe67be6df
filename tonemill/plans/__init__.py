"""The registered queries and their SQL for DuckDB."""

from . import blocks, controls, files, gates, numbers, params, performance, pool, signal, zones  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
