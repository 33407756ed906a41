"""Constants of the engine. All are defaults of arguments."""

# Fixed values, which results depend on.
TRADING_DAYS = 252
WEEK_DAYS, MONTH_DAYS = 5, 21
BENCHMARKS = {"S&P 500 (US)": "^GSPC", "STOXX Europe 600": "^STOXX", "FTSE 100 (UK)": "^FTSE", "ISEQ (Ireland)": "^ISEQ", "Nifty 50 (India)": "^NSEI", "DAX (Germany)": "^GDAXI"}
MIN_OBSERVATIONS = 30
STALE_AFTER_HOURS = 24
GAP_DAYS, EXTREME_MOVE, SPARSE_GAP_DAYS = 7, 0.30, 4
ROLLING_WINDOW, CONFIDENCE = 60, 0.95
REGIME_HIGH, REGIME_LOW, SPIKE_MULTIPLE = 1.75, 0.6, 1.75
EPISODE_DEPTH, PEAK_TOLERANCE, DRAWDOWN_TOLERANCE = 0.10, 1e-12, -1e-9
BOOTSTRAP_SAMPLES, SEED, MIN_TAIL, EDGE_RATIO = 2000, 20250820, 5, 0.9
FAT_TAIL_KURTOSIS, ALPHA = 1.0, 0.05
DOF_RANGE = (2.5, 250.0)
PATHS, BATCHES, MIN_SIMULATED_TAIL = 10_000, 10, 100
GARCH_SCALE, GARCH_MIN, ARCH_LAGS = 100.0, 250, 10
HIGH_PERSISTENCE, UNRELIABLE_PERSISTENCE = 0.98, 0.995
BASEL_DAYS, BASEL_GREEN, BASEL_YELLOW, LOW_POWER = 250, 4, 9, 500
MIN_OVERLAP, SAME_BET, CONCENTRATED = 60, 0.90, 0.5
TREND_YEARS = 4
WACC_SHOCK, GROWTH_SHOCK = 0.0025, 0.0050
GRID_STEPS = (-0.010, -0.005, 0.0, 0.005, 0.010)
SCENARIOS = (
    ("Base case", 0.0, 0.0),
    ("Rates rise 100bp", 0.010, 0.0),
    ("Rates rise 200bp", 0.020, 0.0),
    ("Growth stalls (-100bp)", 0.0, -0.010),
    ("Risk premium widens 150bp", 0.015, 0.0),
    ("Stagflation: rates +200bp, growth -100bp", 0.020, -0.010),
    ("Soft landing: rates -100bp, growth +50bp", -0.010, 0.005),
)
COMPOSITE_WEIGHTS = {"market": 0.40, "fundamental": 0.30, "valuation": 0.30}
REGIME_POINTS = 8.0
