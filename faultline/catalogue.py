"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from .plans import cases, core, detail, study

QUERIES: dict = {**core.QUERIES, **study.QUERIES, **detail.QUERIES, **cases.QUERIES}
ORACLES: dict[str, str] = {**core.ORACLES, **study.ORACLES, **detail.ORACLES, **cases.ORACLES}
