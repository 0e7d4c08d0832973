"""Study parameters: everything an operator takes as a default lives here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Fixed values of the study (must equal the published ones).
COACH_ONLY_CODES = ("coach", "coach||coach", "coach||coach||coach")
ROUTES = ("JFK-LAX", "LAX-JFK", "BOS-LGA", "LGA-BOS")
US_HOLIDAYS_2022 = (date(2022, 5, 30), date(2022, 6, 20), date(2022, 7, 4), date(2022, 9, 5))
SWEEP_WINDOWS = (3, 5, 7, 10, 14, 20, 30)
SIGMA_LEVELS = (1.5, 2.0, 2.5, 3.0, 4.0)
LENGTH_LEVELS = (5, 10, 15, 20, 30, 40, 60)
HORIZON_EDGES = (0, 3, 7, 14, 21, 30, 45, 61)
HORIZON_LABELS = ("1-3", "4-7", "8-14", "15-21", "22-30", "31-45", "46-60")
DAYPART_EDGES = (-1, 5, 8, 12, 17, 21, 24)
DAYPART_LABELS = ("red-eye", "early", "morning", "afternoon", "evening", "night")
EXPECTED_SUBSET_ROWS = 2_156_316


@dataclass(frozen=True)
class Params:
    """One study's constants; make a new one for another calendar or market."""

    # the two clocks
    search_start: date = date(2022, 4, 16)
    search_end: date = date(2022, 10, 5)
    flight_start: date = date(2022, 4, 17)
    flight_end: date = date(2022, 11, 19)
    #: last departure whose trajectory was observed close to departure
    full_trajectory_end: date = date(2022, 10, 12)
    probe_date: date = date(2022, 11, 24)
    #: a departure date is censored when never observed within this many days
    censor_days: int = 7

    # population
    coach_codes: tuple[str, ...] = COACH_ONLY_CODES
    routes: tuple[str, ...] = ROUTES

    # calendar
    holidays: tuple[date, ...] = US_HOLIDAYS_2022
    season_start: date = date(2022, 5, 30)
    season_end: date = date(2022, 9, 5)
    holiday_band: int = 21

    # spike definition
    sigma: float = 2.0
    window: int = 10
    min_periods: int = 5
    direction: str = "up"
    lags: tuple[int, ...] = (1, 2, 3)

    # validation
    n_splits: int = 5
    test_days: int = 14
    min_train_days: int = 30
    date_col: str = "flightDate"

    # models
    seed: int = 42
    n_trees: int = 300
    route_trees: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    min_route_rows: int = 50_000


DEFAULTS = Params()
