"""Constants that are part of the results. Fixed values of the method."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

SEASON, HORIZON = 7, 28
N_EVAL, N_CALIB = 3, 3
N_WINDOWS = N_EVAL + N_CALIB
STATS_DAYS, MIN_HISTORY = 730, 365
SERVICE_LEVELS, LEAD_TIMES = (0.90, 0.95, 0.99), (3, 7, 14)
DEFAULT_LEVEL, DEFAULT_LEAD, DEFAULT_METHOD = 0.95, 7, "sqrt"
SS_METHODS = ("sqrt", "acumulado", "empirico")
LAGS = (7, 14, 28)
#: (name, lag, rows, statistic)
ROLLING = (("mean_7_lag7", 7, 7, "avg"), ("mean_28_lag7", 7, 28, "avg"), ("mean_14_lag14", 14, 14, "avg"), ("mean_28_lag28", 28, 28, "avg"), ("std_28_lag28", 28, 28, "stddev_samp"))
EVENT_CAP, PRICE_ROWS = 7, 91
ABC_CUTS, XYZ_CUTS, ADI_CUT, CV2_CUT = (0.80, 0.95), (0.5, 1.0), 1.32, 0.49
CLASSIFY_DAYS = 365
EXTEND_CYCLE, CLASSIC_WINDOW = 14, 56
INTERVAL_LEVELS = (80, 95)
FILL_TARGETS = (0.90, 0.95, 0.98)
FRONTIER_LEVELS = (0.001, 0.01, 0.03, 0.07, 0.15, 0.25, 0.35, 0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.925, 0.95, 0.965, 0.98, 0.99, 0.995, 0.999, 0.9999, 0.99999)
ORDER_COSTS, HOLDING_RATES = (2.5, 5.0, 10.0), (0.15, 0.25, 0.35)

#: Weeks of the catalogue's panel begin on Saturdays.
WEEK_ZERO = dt.date(1994, 12, 31)
#: (month, day, name, type)
EVENTS = ((2, 1, "SuperBowl", "Sporting"), (5, 10, "MothersDay", "Cultural"), (11, 25, "Thanksgiving", "National"), (12, 25, "Christmas", "National"))

#: The catalogue's boosted model: as many trees, at the rate, as the method states.
CATALOGUE_TREES = {"rounds": 600, "rate": 0.05}


@dataclass(frozen=True)
class Costs:
    unit_cost_ratio: float = 0.70
    holding_rate_annual: float = 0.25
    order_cost: float = 5.0
    max_cover_days: float = 14.0
