"""Fixed values the results depend on. Changing one changes what is computed."""

from __future__ import annotations

# Model identity and policies.
MODEL_VERSION = "baseline-zil-0.1.0"
THRESHOLD_POLICY_VERSION = "grid-v1"
CUTOFF_POLICY = "kickoff_minus_90m/v1"
GRADING_TARGET = "official_corrected"
AGGREGATES_VERSION = 2

# Form window.
TRAILING_WINDOW = 8
HALF_LIFE_GAMES = 4.0
TRAILING_BASELINE = 5

# Shrinkage and fitting.
K0 = 4.0
SIGMA_FLOOR = 0.35
COUNT_MIN_DISPERSION = 1.05
COUNT_MEAN_FLOOR = 1e-4
DEFAULT_PMF_CAP = 15
MIN_ELIGIBLE_GAMES = 1

# Ordinal confidence.
MIN_HISTORY_FOR_MEDIUM = 3
N_FOR_HIGH = 6
CONTINUOUS = "continuous_nonneg"
COUNT = "count"
CONFIDENCE_BANDS = {
    CONTINUOUS: {"w_high": 1.45, "w_low": 2.00, "floor": 10.0, "offset": 0.0},
    COUNT: {"w_high": 1.10, "w_low": 1.50, "floor": 0.0, "offset": 1.0},
}
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.7, "low": 0.4}

# Distribution kinds and the emitted quantile grid.
KIND_ZIL = "zero_inflated_lognormal"
KIND_NB = "negative_binomial"
QUANTILE_GRID = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
QUANTILE_NAMES = ("q05", "q10", "q25", "q50", "q75", "q90", "q95")

# Clocks.
EASTERN = "America/New_York"
CUTOFF_MINUTES_BEFORE_KICKOFF = 90
CUTOFF_SCHEDULE_LOOKBACK_DAYS = 7
RETURNING_ABSENCE_WEEKS = 5
ARCHIVED_FORECAST_FROM_SEASON = 2021
FORECAST_LAG_HOURS = {"archived_forecast": 12, "reanalysis": 24}
POSTSEASON_RELEASE_DAYS = 5

# Calibration.
CALIBRATION_BINS = 10
REPORTING_FLOOR = 1_000
LOG_LOSS_EPS = 1e-12

# Volume floor per stat type.
CONTRACT_LIKE_FLOORS = {
    "passing_yards": 100.0,
    "rushing_yards": 20.0,
    "receiving_yards": 20.0,
    "receptions": 2.0,
    "rushing_tds": 0.2,
    "receiving_tds": 0.2,
}

# Stat types as (name, family, first threshold, last threshold, step, pmf cap).
STAT_TYPES = (
    ("passing_yards", CONTINUOUS, 149.5, 349.5, 25.0, None),
    ("rushing_yards", CONTINUOUS, 24.5, 124.5, 10.0, None),
    ("receiving_yards", CONTINUOUS, 24.5, 124.5, 10.0, None),
    ("receptions", COUNT, 1.5, 8.5, 1.0, 15),
    ("rushing_tds", COUNT, 0.5, 1.5, 1.0, 4),
    ("receiving_tds", COUNT, 0.5, 1.5, 1.0, 4),
)

# Stat-line columns by phase, and the roles that play a phase
# without an opportunity of its own.
PHASE_COLUMNS = {
    "passing": ("passing_yards", "passing_tds", "passing_attempts", "completions", "interceptions"),
    "rushing": ("rushing_yards", "rushing_tds", "carries"),
    "receiving": ("receiving_yards", "receiving_tds", "receptions", "targets"),
}
RUSHING_ROLES = ("RB", "FB")
RECEIVING_ROLES = ("RB", "FB", "WR", "TE")

# Stat-line source column names and kinds.
STAT_COLUMN_SOURCES = (
    ("passing_yards", "passing_yards", "decimal"),
    ("passing_tds", "passing_tds", "int"),
    ("passing_attempts", "attempts", "int"),
    ("completions", "completions", "int"),
    ("interceptions", "passing_interceptions", "int"),
    ("rushing_yards", "rushing_yards", "decimal"),
    ("rushing_tds", "rushing_tds", "int"),
    ("carries", "carries", "int"),
    ("receiving_yards", "receiving_yards", "decimal"),
    ("receiving_tds", "receiving_tds", "int"),
    ("receptions", "receptions", "int"),
    ("targets", "targets", "int"),
)

# Decimal places applied before a row is written or digested.
QUANTISATION = {
    "projected_value": 3,
    "interval_low": 3,
    "interval_high": 3,
    "mass_below_zero": 6,
    "relative_width": 4,
    "actual": 1,
    "actual_percentile": 4,
    "abs_error": 4,
    "sq_error": 4,
    "baseline_season_avg": 3,
    "baseline_trailing5": 3,
    "baseline_season_avg_abs_error": 4,
    "baseline_trailing5_abs_error": 4,
    "threshold": 1,
    "probability": 6,
    "tail_mass": 6,
    "zero_mass": 6,
}

# Fields that are wall clock or location, never content.
NON_CONTENT_FIELDS = (
    "computed_at",
    "started_at",
    "finished_at",
    "duration_seconds",
    "artifact_path",
    "run_id",
    "generated_at",
)

# Market series and team spellings.
SERIES_STAT_TYPES = {
    "KXNFLPASSYDS": "passing_yards",
    "KXNFLRSHYDS": "rushing_yards",
    "KXNFLRECYDS": "receiving_yards",
    "KXNFLREC": "receptions",
}
TEAM_CODES = (
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN", "DET",
    "GB", "HOU", "IND", "JAX", "KC", "LA", "LAC", "LV", "MIA", "MIN", "NE", "NO",
    "NYG", "NYJ", "PHI", "PIT", "SEA", "SF", "TB", "TEN", "WAS",
)
TEAM_ALIASES = {"LAR": "LA", "WSH": "WAS", "JAC": "JAX", "OAK": "LV", "SD": "LAC", "STL": "LA"}
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")

EARTH_RADIUS_KM = 6371.0

# Market rules.
RECOMMENDATION_THRESHOLD_POINTS = 5.0
PRICE_HEARTBEAT_MINUTES = 15
INACTIVES_LEAD_MINUTES = 90
FINAL_SNAPSHOT_WINDOW_MINUTES = 45
GAMEDAY_WINDOW_MINUTES = 360

# Health bounds.
INGEST_LATE_AFTER_HOURS = 26
RECOMPUTE_LATE_AFTER_HOURS = 26
PRICE_IN_WEEK_CADENCE_MINUTES = 60
PRICE_GAMEDAY_CADENCE_MINUTES = 15
PRICE_LATE_CADENCE_MULTIPLIER = 2
GAMEDAY_PRICE_WINDOW_HOURS = 6
RUN_TIMEOUT_MINUTES = 120
SEASON_LOOKAHEAD_DAYS = 7
STALE_RUN_HOURS = 24

# Ingest cycle membership.
REQUIRED_SOURCES = ("schedule", "pbp", "stats", "context")
OPTIONAL_SOURCES = ("weather",)
REQUIRED_COVERAGE_DATASETS = ("stats", "schedule")

# Snap measures as (context type, source column, decimal places).
SNAP_MEASURES = (
    ("snap_count_offense", "offense_snaps", 0),
    ("snap_pct_offense", "offense_pct", 3),
    ("snap_count_defense", "defense_snaps", 0),
    ("snap_pct_defense", "defense_pct", 3),
    ("snap_pct_st", "st_pct", 3),
)

# Outcome reasons and stages.
REASON_NO_ACTUAL = "no_actual_stat_line"
REASON_CUTOFF_AFTER_KICKOFF = "cutoff_after_kickoff"
REASON_NO_PRIOR = "no_prior_evidence"
REASON_HARNESS_ERROR = "harness_error"
REASON_INSUFFICIENT_HISTORY = "insufficient_history"
REASON_BASELINE_UNAVAILABLE = "baseline_unavailable"
MAX_CANDIDATE_ERRORS = 100
EXCLUDED_SAMPLE = 10

# Surrogate-key namespace.
KEY_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
