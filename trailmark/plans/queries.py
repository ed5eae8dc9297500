"""Every query of the library over the driver's tables, and its SQL twin."""

from __future__ import annotations

from . import q_catalog, q_estimation, q_geometry, q_matching, q_residuals, q_series, q_text

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (q_series, q_geometry, q_matching, q_estimation, q_residuals, q_catalog, q_text):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
