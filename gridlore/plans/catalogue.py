"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import q_cells, q_clean, q_climate, q_metrics, q_more, q_parts, q_pins, q_raster, q_recommend, q_scan

_ALL = {k: v for m in (q_clean, q_cells, q_metrics, q_climate, q_recommend, q_more, q_parts, q_pins, q_raster, q_scan) for k, v in m.QUERIES.items()}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}
