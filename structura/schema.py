"""Column names, enums and defaults that the engine's tables share."""

from __future__ import annotations

KEYS = ["symbol", "freq"]
BAR_COLUMNS = ["dt", "open", "high", "low", "close", "volume"]

# The protocol's defaults and code words.
MIN_K_GAP = 3
MA_PERIODS = (5, 13, 21, 34, 55, 89, 144, 233)
MAX_LEVELS = 8
MIN_UNITS_FOR_NEXT = 3
UPGRADE_UNITS = 9
WEDGE_MIN_RUN = 4
